"""A graph and a deep client over DataFrames, with the operators as methods."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tessella.operators import lookups, pairs, sampling, walks
from tessella.operators.graph import node_frequency


@dataclass
class GraphClient:
    edges: DataFrame
    node_features: DataFrame | None = None
    neighbor_features: DataFrame | None = None
    seed: int = 0

    def _dist(self, kind: int) -> DataFrame:
        return sampling.negative_distribution(node_frequency(self.edges), kind)

    def shared_sample_negative(self, count: int, nodes: DataFrame, excluded: DataFrame, kind: int = sampling.PARTIAL_SUM) -> DataFrame:
        return sampling.shared_negatives(nodes, self._dist(kind), excluded, count, self.seed)

    def indep_sample_negative(self, count: int, nodes: DataFrame, excluded: DataFrame, kind: int = sampling.PARTIAL_SUM) -> DataFrame:
        return sampling.independent_negatives(nodes, self._dist(kind), excluded, count, self.seed)

    def static_traverse(self, starts: DataFrame, length: int, meta_path: list[int] | None = None, weighted: bool = False) -> DataFrame:
        return walks.random_walks(starts, self.edges, length, self.seed, weighted, meta_path=meta_path)

    def random_sample_neighbor(self, count: int, nodes: DataFrame, weighted: bool = False) -> DataFrame:
        return sampling.sample_neighbors(nodes, self.edges, count, self.seed, weighted)

    def lookup_node_feature(self, nodes: DataFrame) -> DataFrame:
        return lookups.lookup_features(nodes, self.node_features)

    def lookup_neighbor_feature(self, nodes: DataFrame) -> DataFrame:
        return lookups.lookup_features(nodes, self.neighbor_features)

    def lookup_feature(self, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
        return self.lookup_node_feature(nodes), self.lookup_neighbor_feature(nodes)

    def lookup_context(self, nodes: DataFrame) -> DataFrame:
        return lookups.lookup_context(nodes, self.edges)


@dataclass
class DeepClient:
    frequencies: DataFrame
    item_features: DataFrame | None = None
    instances: DataFrame | None = None  # idx, node, labels
    seed: int = 0

    def shared_sample_negative(self, count: int, nodes: DataFrame, excluded: DataFrame, kind: int = sampling.PARTIAL_SUM) -> DataFrame:
        return sampling.shared_negatives(nodes, sampling.negative_distribution(self.frequencies, kind), excluded, count, self.seed)

    def lookup_item_feature(self, items: DataFrame) -> DataFrame:
        return lookups.lookup_items(items, self.item_features)

    def sample_instance(self, count: int) -> DataFrame:
        return sampling.sample_instances(self.instances, "idx", self.instances.count(), count, self.seed)

    def softmax_instances(self, samples: DataFrame, count: int) -> DataFrame:
        return pairs.softmax_columns(samples, sampling.negative_distribution(self.frequencies), count, self.seed)
