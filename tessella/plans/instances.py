"""Training instances of the model families, as compositions of the operators. Each returns named DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.ids import type_of
from tessella.functions.rng import uniform
from tessella.operators import graph, lookups, pairs, sampling, subgraphs, walks

Instances = dict[str, DataFrame]


def _subgraph(nodes: DataFrame, edges: DataFrame, features: DataFrame, fanouts: list[int], seed: int, drop: float = 0.0, mask: float = 0.0) -> Instances:
    """levels, blocks and the features of all their nodes; drop and mask thin out edges and features."""
    levels, links = subgraphs.sample_levels(nodes, edges, fanouts, seed)
    if drop:
        links = subgraphs.drop_edges(links, drop, seed)
    found = lookups.lookup_features(levels.select("node").distinct(), features)
    if mask:
        found = subgraphs.mask_features(found, mask, seed)
    return {"levels": levels, "blocks": subgraphs.blocks(levels, links, len(fanouts)), "features": found}


def skip_gram(seqs: DataFrame, freq: DataFrame, window: int = 10, num_neg: int = 5, seed: int = 0) -> Instances:
    """src, dst, y from sequences (key, nodes)"""
    contexts = pairs.context_pairs(seqs, "key", "nodes", window, window)
    return {"pairs": pairs.pairs_with_negatives(contexts, sampling.negative_distribution(freq), num_neg, seed)}


def skip_gram_with_features(seqs: DataFrame, freq: DataFrame, features: DataFrame, window: int = 5, num_neg: int = 5, seed: int = 0) -> Instances:
    """The same, and the features of the sources with their own ids among them"""
    out = skip_gram(seqs, freq, window, num_neg, seed)
    nodes = out["pairs"].select(F.col("src").alias("node")).distinct()
    return out | {"features": pairs.with_self(lookups.lookup_features(nodes, features), nodes)}


def unsupervised_subgraphs(edges: DataFrame, features: DataFrame, fanouts: list[int], num_neg: int = 5, seed: int = 0) -> Instances:
    """Edges with negatives, and the sampled subgraph of all their ends"""
    dist = sampling.negative_distribution(graph.node_frequency(edges))
    out = pairs.edges_with_negatives(edges, dist, num_neg, seed)
    ends = out.select(F.col("src").alias("node")).union(out.select("dst")).distinct()
    return {"pairs": out} | _subgraph(ends, edges, features, fanouts, seed)


def bipartite_subgraphs(edges: DataFrame, features: DataFrame, fanouts: list[int], user: int, item: int, num_neg: int = 5, seed: int = 0) -> Instances:
    """The same for edges from users to items, with a subgraph for each side"""
    dist = sampling.negative_distribution(graph.node_frequency(edges))
    out = pairs.edges_with_negatives(edges.filter(type_of(F.col("src")) == user), dist, num_neg, seed)
    sides = {"user": out.select(F.col("src").alias("node")), "item": out.select(F.col("dst").alias("node")).filter(type_of(F.col("dst")) == item)}
    return {"pairs": out} | {
        f"{side}_{name}": df for side, nodes in sides.items() for name, df in _subgraph(nodes.distinct(), edges, features, fanouts, seed).items()
    }


def supervised_subgraphs(labels: DataFrame, edges: DataFrame, features: DataFrame, fanouts: list[int], num_label: int = 1, max_label: int = 1, seed: int = 0) -> Instances:
    """Labels by position, and the sampled subgraph of the labelled nodes"""
    return {"labels": pairs.label_matrix(labels, num_label, max_label)} | _subgraph(labels.select("node"), edges, features, fanouts, seed)


def semi_supervised_subgraphs(rows: DataFrame, edges: DataFrame, features: DataFrame, fanouts: list[int], num_neg: int = 5, discard: float = 0.0, seed: int = 0) -> Instances:
    """From labelled edges (src, dst, node, labels): edges with negatives, the labels that are not discarded, the subgraph of all"""
    dist = sampling.negative_distribution(graph.node_frequency(edges))
    out = pairs.edges_with_negatives(rows.select("src", "dst"), dist, num_neg, seed)
    kept = rows.select("node", "labels").distinct().filter(uniform(seed, "node") >= discard)
    every = out.select(F.col("src").alias("node")).union(out.select("dst")).union(kept.select("node")).distinct()
    return {"pairs": out, "labels": kept.select("node", F.posexplode("labels").alias("position", "label"))} | _subgraph(every, edges, features, fanouts, seed)


def infomax(nodes: DataFrame, edges: DataFrame, features: DataFrame, fanouts: list[int], seed: int = 0) -> Instances:
    """A subgraph, and its features dealt out to other nodes of the namespace"""
    out = _subgraph(nodes, edges, features, fanouts, seed)
    dist = sampling.negative_distribution(graph.node_frequency(edges), sampling.UNIFORM)
    moved = pairs.global_shuffle(out["levels"].select("node").distinct(), dist, seed)
    others = lookups.lookup_features(moved.select("node", F.col("drawn")).withColumnRenamed("node", "to").withColumnRenamed("drawn", "node"), features)
    return out | {"shuffled_features": others.select(F.col("to").alias("node"), "fid", "v")}


def contrastive(nodes: DataFrame, edges: DataFrame, features: DataFrame, fanouts: list[int], drops: tuple = (0.2, 0.4), masks: tuple = (0.3, 0.4), seed: int = 0) -> Instances:
    """Two views of a subgraph, with edges dropped and features masked at their own rates"""
    views = {side: _subgraph(nodes, edges, features, fanouts, seed + 100 * k, drops[k], masks[k]) for k, side in enumerate(("left", "right"))}
    return {f"{side}_{name}": df for side, view in views.items() for name, df in view.items()}


def multi_view(nodes: DataFrame, edges: DataFrame, features: DataFrame, fanouts: list[int], enhanced: list[int], seed: int = 0) -> Instances:
    """Two views of different fan-outs"""
    views = {"plain": _subgraph(nodes, edges, features, fanouts, seed), "enhanced": _subgraph(nodes, edges, features, enhanced, seed)}
    return {f"{side}_{name}": df for side, view in views.items() for name, df in view.items()}


def two_tower(samples: DataFrame, freq: DataFrame, item_features: DataFrame | None = None, num_neg: int = 5, add_node: bool = True, seed: int = 0) -> Instances:
    """From user samples (row, item, fid, v): user features, items by column, and the distinct items' features"""
    clicked = samples.select("row", "item").distinct()
    items = pairs.softmax_columns(clicked, sampling.negative_distribution(freq), num_neg, seed)
    out = {"user_features": samples.select("row", "fid", "v"), "items": items}
    if item_features is not None:
        nodes = items.select(F.col("item").alias("node")).distinct()
        found = lookups.lookup_items(nodes, item_features)
        out["item_features"] = pairs.with_self(found, nodes) if add_node else found
    return out


def node_of_rows(samples: DataFrame, kind: int) -> DataFrame:
    """row, node: the one id of that type among a row's features (row, fid, v); none or several raise when read"""
    own = F.when(type_of(F.col("fid")) == kind, F.col("fid"))
    wrong = F.raise_error(F.concat(F.lit(f"not one id of type {kind} in row "), F.col("row")))
    found = samples.groupBy("row").agg(F.count(own).alias("n"), F.min(own).alias("node"))
    return found.select("row", F.when(F.col("n") == 1, F.col("node")).otherwise(wrong).cast("long").alias("node"))


def graph_two_tower(samples: DataFrame, edges: DataFrame, features: DataFrame, freq: DataFrame, fanouts: list[int], user: int, num_neg: int = 5, add_node: bool = True, seed: int = 0) -> Instances:
    """two_tower, with each row's user, a node of the graph, and the sampled subgraph of all users. Item features are node features."""
    users = node_of_rows(samples, user)
    tower = two_tower(samples, freq, None, num_neg, add_node, seed)
    items = tower["items"].select(F.col("item").alias("node")).distinct()
    found = lookups.lookup_features(items, features)
    tower["item_features"] = pairs.with_self(found, items) if add_node else found
    return tower | {"users": users} | _subgraph(users.select("node"), edges, features, fanouts, seed)


def _ranking(samples: DataFrame, edges: DataFrame, user: int, item: int, length: int, window: int, num_neg: int, seed: int) -> Instances:
    """The rows with their users and items, and pairs from walks that start once at each of these"""
    users, items = node_of_rows(samples, user), node_of_rows(samples, item)
    starts = users.select("node").union(items.select("node"))
    seqs = walks.sequences(walks.random_walks(starts, edges, length, seed))
    met = pairs.cross_type_pairs(seqs, "start", "nodes", window, user)
    dist = sampling.negative_distribution(graph.node_frequency(edges))
    return {"rows": samples, "users": users, "items": items, "pairs": pairs.edges_with_negatives(met, dist, num_neg, seed)}


def graph_ranking(samples: DataFrame, edges: DataFrame, features: DataFrame, fanouts: list[int], user: int, item: int, length: int = 5, window: int = 5, num_neg: int = 5, seed: int = 0) -> Instances:
    """For ranking and a graph together: samples (row, y, fid, v), user-item pairs from walks, and the subgraph of all users"""
    out = _ranking(samples, edges, user, item, length, window, num_neg, seed)
    nodes = out["users"].select("node").union(out["pairs"].select("src"))
    return out | _subgraph(nodes, edges, features, fanouts, seed)


def bipartite_graph_ranking(samples: DataFrame, edges: DataFrame, features: DataFrame, fanouts: list[int], user: int, item: int, length: int = 5, window: int = 5, num_neg: int = 5, seed: int = 0) -> Instances:
    """The same, with a subgraph of all items beside that of all users"""
    out = _ranking(samples, edges, user, item, length, window, num_neg, seed)
    sides = {"user": out["users"].select("node").union(out["pairs"].select("src")), "item": out["items"].select("node").union(out["pairs"].select("dst"))}
    return out | {f"{side}_{name}": df for side, nodes in sides.items() for name, df in _subgraph(nodes, edges, features, fanouts, seed).items()}
