"""Text files of graphs and samples, in and out."""
