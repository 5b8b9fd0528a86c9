"""Graph, sampling, sequence, tensor and evaluation operators, from DataFrames to DataFrames."""
