"""Mixing sources to target weights, counted in tokens of a public tokenizer.

A record is one document. Records of different sources with one text are the same record, the first of each with the first of the
others and so on; a record's membership pattern is the set of sources that hold it and have a target. Patterns, not records, are the
nodes of a min-cost flow: tokens run from a pattern to the quotas of its sources, and each further repetition of a pattern costs more
than the one before.

The flow is realised as planned: the records of a pattern lie in one seeded order on a line of tokens, and each source takes the
stretch of the line that follows that of the source before, going round as often as the flow repeats the pattern. So no record is used
k + 1 times before all were used k times, and no source uses a record more often than it may.

Defined results: null and empty texts have no tokens and are never chosen; sources compare without case and outer blanks; sources
without a target and targets without records are left out or stay empty; a target given twice counts with its greatest weight;
weights below or equal to 0 get nothing; max_repeats null counts as 1; texts are counted whole; repeated rows of a doc_id count once;
extra columns are ignored. The flow graph, one node a pattern that occurs, is held by the driver and checked against `most_patterns`.
"""

from __future__ import annotations

import base64
import os
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netquarry.core import broadcast_if_small, materialise, numbered, salted_join

TOKENIZER = os.environ.get("NETQUARRY_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: how the public byte-level vocabulary cuts text into pieces.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BINS = 4096  # of a pattern's line, summed each by itself


def _encoder(key: str, vocabulary: bytes):
    import tiktoken

    held = getattr(tiktoken, "_netquarry_encoders", None)
    if held is None:
        held = tiktoken._netquarry_encoders = {}
    if key not in held:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        held[key] = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
    return held[key]


def count_tokens(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source (as compared), text_id (a hash of the text), n_tokens; texts without tokens are left out.

    The vocabulary is read by the driver and broadcast, a few megabytes of fixed size, so executors need no copy of the file."""
    d = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.trim("source")).alias("source"), "text", F.unhex(F.md5(F.col("text").cast("binary"))).alias("text_id"))
    d = d.filter("doc_id is not null and source is not null and text <> ''")
    with open(tokenizer, "rb") as f:
        held = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = None
        for b in batches:
            enc = enc or _encoder(tokenizer, held.value)
            n = [len(enc.encode_ordinary(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("text_id"), pa.array(n, pa.int64())], names=["doc_id", "source", "text_id", "n_tokens"])

    return d.mapInArrow(run, "doc_id long, source string, text_id binary, n_tokens long")


def records(counted: DataFrame) -> DataFrame:
    """text_id, copy, n_tokens, docs (source, doc_id), pattern: the k-th document of a text in each source is one record.

    Documents are numbered over all tasks, so a text with a third of them is no group of one task."""
    n = numbered(counted.groupBy("doc_id", "source").agg(F.min("text_id").alias("text_id"), F.max("n_tokens").alias("n_tokens")), ["text_id", "source", "doc_id"])
    # a pair of text and source held by one document is its own first: only the others are looked up
    many = n.groupBy("text_id", "source").agg(F.count("*").alias("_k"), F.min("n").alias("_first")).filter("_k > 1").drop("_k")
    n = salted_join(n, many, ["text_id", "source"], "left", salts=4, by=F.col("doc_id"))
    n = n.withColumn("copy", F.col("n") - F.coalesce("_first", "n"))
    one = n.groupBy("text_id", "copy").agg(F.max("n_tokens").alias("n_tokens"), F.array_sort(F.collect_set(F.struct("source", "doc_id"))).alias("docs"))  # at most a document a target
    return one.withColumn("pattern", F.array_join("docs.source", "\n"))


def min_cost_flow(supply: dict[tuple[str, ...], int], quota: dict[str, int], repeats: dict[str, int]) -> dict[tuple[tuple[str, ...], str], int]:
    """Tokens that each pattern sends to each of its sources: as much as the quotas take, at the least cost of repetition.

    The k-th use of a pattern costs k - 1 a token; a source uses it at most `repeats` times. Successive shortest paths."""
    graph: list[list[int]] = [[], []]
    to: list[int] = []
    cap: list[int] = []
    cost: list[int] = []

    def arc(a: int, b: int, c: int, w: int) -> int:
        graph[a].append(len(to))
        to.append(b)
        cap.append(c)
        cost.append(w)
        graph[b].append(len(to))
        to.append(a)
        cap.append(0)
        cost.append(-w)
        return len(to) - 2

    sources = {}
    for s in sorted(quota):
        sources[s] = len(graph)
        graph.append([])
        arc(sources[s], 1, quota[s], 0)
    used: dict[tuple[tuple[str, ...], str], int] = {}
    for p in sorted(supply):
        node = len(graph)
        graph.append([])
        for k in range(sum(repeats[s] for s in p)):
            arc(0, node, supply[p], k)
        for s in p:
            used[p, s] = arc(node, sources[s], supply[p] * repeats[s], 0)
    while True:
        dist: list[float] = [float("inf")] * len(graph)
        dist[0], back, queue, inside = 0, [-1] * len(graph), deque([0]), [False] * len(graph)
        while queue:
            a = queue.popleft()
            inside[a] = False
            for e in graph[a]:
                b = to[e]
                if cap[e] > 0 and dist[a] + cost[e] < dist[b]:
                    dist[b], back[b] = dist[a] + cost[e], e
                    if not inside[b]:
                        inside[b] = True
                        queue.append(b)
        if back[1] < 0:
            break
        push, v = None, 1
        while v:
            push = cap[back[v]] if push is None else min(push, cap[back[v]])
            v = to[back[v] ^ 1]
        v = 1
        while v:
            cap[back[v]] -= push
            cap[back[v] ^ 1] += push
            v = to[back[v] ^ 1]
    return {k: cap[e ^ 1] for k, e in used.items() if cap[e ^ 1]}


def stretches(flow: dict[tuple[tuple[str, ...], str], int]) -> dict[tuple[tuple[str, ...], str], tuple[int, int]]:
    """Where on the line of its pattern each source begins, and how far it goes."""
    at: dict[tuple[str, ...], int] = {}
    out = {}
    for (p, s), n in sorted(flow.items()):
        out[p, s] = (at.get(p, 0), n)
        at[p] = at.get(p, 0) + n
    return out


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 1, tokenizer: str = TOKENIZER, most_patterns: int = 500_000) -> tuple[DataFrame, DataFrame]:
    """The mixture (doc_id, source, copies, n_tokens) and the report of shares by source.

    total_tokens: the size to reach, by default what the sources with a target hold, each record once."""
    spark = documents.sparkSession
    t = targets.select(F.lower(F.trim("source")).alias("source"), F.col("weight").cast("double").alias("w"), F.coalesce(F.col("max_repeats"), F.lit(1)).cast("int").alias("r"))
    t = t.filter("source is not null and w > 0 and r > 0").groupBy("source").agg(F.max("w").alias("w"), F.max("r").alias("r"))
    goal = {x["source"]: (x["w"], x["r"]) for x in t.collect()}  # a row a target, as the user wrote them down
    counted = count_tokens(documents, tokenizer).join(F.broadcast(t.select("source")), "source", "left_semi")
    one = materialise(records(counted), "records")
    sums = materialise(one.groupBy("pattern").agg(F.sum("n_tokens").alias("n")), "patterns")
    if sums.count() > most_patterns:
        raise ValueError(f"more than {most_patterns} sets of sources share records; raise most_patterns if the driver can hold their flow")
    supply = {tuple(x["pattern"].split("\n")): x["n"] for x in sums.collect() if x["n"]}
    held: dict[str, int] = dict.fromkeys(goal, 0)
    for p, n in supply.items():
        for s in p:
            held[s] += n
    total = sum(supply.values()) if total_tokens is None else total_tokens
    weights = sum(w for w, _ in goal.values())
    quota = {s: int(total * w / weights) for s, (w, _) in goal.items()}
    flow = min_cost_flow(supply, quota, {s: r for s, (_, r) in goal.items()})
    plan = [("\n".join(p), s, a, n, supply[p]) for (p, s), (a, n) in stretches(flow).items()]
    plan_df = spark.createDataFrame(plan, "pattern string, source string, start long, size long, line long")
    plan_df = plan_df.groupBy("pattern", "line").agg(F.collect_list(F.struct("source", "start", "size")).alias("parts"))
    side, small = broadcast_if_small(plan_df)
    order = F.pmod(F.xxhash64("text_id", "copy", F.lit(seed)), F.lit(1 << 40))
    line = one.withColumn("pos", order).withColumn("bin", F.floor(F.col("pos") / ((1 << 40) // BINS)))
    before = Window.partitionBy("pattern").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = line.groupBy("pattern", "bin").agg(F.sum("n_tokens").alias("n")).withColumn("front", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("pattern", "bin").orderBy("pos", "text_id", "copy").rowsBetween(Window.unboundedPreceding, -1)
    line = line.join(bins, ["pattern", "bin"]).withColumn("at", F.col("front") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    line = line.join(side, "pattern") if small else salted_join(line, plan_df, ["pattern"], by=F.col("pos"))
    # a record is used each time the stretch, going round the line, passes its first token
    part = line.select("n_tokens", "docs", "line", "at", F.inline("parts"))
    rounds = lambda end: F.ceil((end - F.col("at")) / F.col("line"))
    part = part.withColumn("copies", (rounds(F.col("start") + F.col("size")) - rounds(F.col("start"))).cast("long")).filter("copies > 0")
    doc = F.get(F.filter("docs", lambda d: d["source"] == F.col("source")), F.lit(0))["doc_id"]
    mixed = part.select(doc.alias("doc_id"), "source", "copies", "n_tokens")
    got = mixed.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.count("*").alias("n_docs"), F.max("copies").alias("most_copies"))
    rows = [(s, w / weights, quota[s], r, held[s], held[s] * r) for s, (w, r) in sorted(goal.items())]
    report = spark.createDataFrame(rows, "source string, target_share double, quota_tokens long, max_repeats int, held_tokens long, reachable_tokens long").join(got, "source", "left")
    every = Window.partitionBy(F.lit(1))  # a row per target
    report = report.fillna(0, ["tokens", "n_docs", "most_copies"])
    report = report.withColumn("shortfall_tokens", F.greatest(F.lit(0).cast("long"), F.col("quota_tokens") - F.col("tokens"))).withColumn("reachable_share", F.col("target_share") * F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("reachable_tokens"), F.col("quota_tokens")), F.lit(1.0))))
    return mixed, report.withColumn("share", F.coalesce(F.try_divide(F.col("tokens"), F.sum("tokens").over(every)), F.lit(0.0)))
