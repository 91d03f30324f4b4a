"""Problem 8: texts in containers of fixed capacity, by vector best-fit.

A container has capacities of tokens, documents and attention cost (the squares of its pieces' lengths).
Pieces are placed by falling size into the open container that holds them under every constraint and
whose weighted residual matches them best: the largest dot product with the piece, or the smallest norm of
what would be left.  Pieces are spread over shards by a hash, each of bounded size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import held
from . import tokens as T

SHARD = 6000  # pieces packed together
DOCS_MOST, ATTENTION_SHARE = 128, 0.75  # pieces of a container, and their attention cost in squares of the capacity; a piece that costs more stands alone
WEIGHTS = (1.0, 0.05, 0.2)  # tokens, documents, attention


def best_fit(size: np.ndarray, capacity: int, separator: int, docs_most: int, attention: float, rule: str = "norm") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Container, slot and first token position of each piece (in the given order, none above capacity)."""
    n = len(size)
    order = np.argsort(-size, kind="stable")
    least = int(size.min()) if n else 0
    tok, doc, att = np.zeros(n), np.zeros(n), np.zeros(n)  # residuals of open containers
    name = np.zeros(n, np.int64)
    filled = np.zeros(n, np.int64)
    used = made = 0
    where, slot, first = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    w = np.array(WEIGHTS)
    for i in order:
        s = int(size[i])
        need = s + separator
        a = float(s) * s
        ok = np.flatnonzero((tok[:used] >= need) & (doc[:used] >= 1) & (att[:used] >= a)) if used else ()
        if len(ok):
            if rule == "dot":
                score = -(w[0] * tok[ok] / capacity * s / capacity + w[1] * doc[ok] / docs_most / docs_most + w[2] * att[ok] / attention * a / attention)
            else:
                score = w[0] * ((tok[ok] - need) / capacity) ** 2 + w[1] * ((doc[ok] - 1) / docs_most) ** 2 + w[2] * ((att[ok] - a) / attention) ** 2
            b = int(ok[np.argmin(score)])
            first[i] = filled[b] + separator
            tok[b] -= need
        else:
            b = used
            used += 1
            name[b], filled[b] = made, 0
            made += 1
            tok[b], doc[b], att[b] = capacity - s, docs_most, attention
            first[i] = 0
        where[i], slot[i] = name[b], docs_most - doc[b]
        filled[b] = first[i] + s
        doc[b] -= 1
        att[b] -= a
        if tok[b] < least + separator or doc[b] < 1 or att[b] < least * least:  # full: the last open one takes its place
            used -= 1
            tok[b], doc[b], att[b], name[b], filled[b] = tok[used], doc[used], att[used], name[used], filled[used]
    return where, slot, first


def pack(docs: DataFrame, specs: DataFrame, key: str = "doc_id", docs_most: int = DOCS_MOST, attention_share: float = ATTENTION_SHARE, rule: str = "norm", path: str = T.TOKENIZER) -> DataFrame:
    """(spec_id, container, slot, key, piece_no, text_from, tokens, container_from): every piece of every selected text.

    Texts longer than a container are cut into full pieces and a rest; null, empty and tokenless texts are
    left out; a spec without capacity packs nothing.  A container's name is its shard and number.  No container holds
    more than docs_most pieces, nor pieces whose squared lengths sum to more than attention_share of its squared
    capacity; a piece that alone costs more has a container to itself.  The specs are a plan table and come to the driver.
    """
    rows = specs.select("spec_id", F.col("capacity_tokens").cast("int").alias("capacity"), F.coalesce(F.col("separator_tokens"), F.lit(0)).cast("int").alias("separator"), "lang_filter").dropDuplicates(["spec_id"]).collect()
    rows = [r for r in rows if r.capacity and r.capacity > 0]
    kind = "array<struct<spec_id: string, capacity: int, separator: int>>"
    cells = [F.when(F.lit(True) if r.lang_filter is None else F.col("lang") == r.lang_filter, F.struct(F.lit(r.spec_id).alias("spec_id"), F.lit(r.capacity).alias("capacity"), F.lit(r.separator).alias("separator"))) for r in rows]
    sized = T.sized(docs, key, ("lang",), path).where("tokens > 0")
    sized = held(sized)
    each = sized.select(key, "tokens", F.explode(F.array_compact(F.array(*cells)) if cells else F.array().cast(kind)).alias("s")).select(key, "tokens", "s.*")
    pieces = each.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / F.col("capacity")).cast("int"))))
    pieces = pieces.select("spec_id", "capacity", "separator", key, (F.col("piece") + 1).alias("piece_no"), (F.col("piece") * F.col("capacity")).cast("long").alias("text_from"), F.least(F.col("capacity"), F.col("tokens") - F.col("piece") * F.col("capacity")).cast("int").alias("size"))
    shards = pieces.groupBy("spec_id").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("shards"))
    pieces = pieces.join(F.broadcast(shards), "spec_id")  # one row for each spec
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64(F.col(key), F.col("piece_no")), F.col("shards")).cast("int"))

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["size", key, "piece_no"], ascending=[False, True, True])
        capacity, separator = int(g.capacity.iloc[0]), int(g.separator.iloc[0])
        where, slot, first = best_fit(g["size"].to_numpy(), capacity, separator, docs_most, attention_share * capacity * capacity, rule)
        name = g.shard.astype(str).to_numpy() + np.char.add("-", where.astype(str)).astype(object)
        return pd.DataFrame({"spec_id": g.spec_id, "container": name, "slot": slot + 1, key: g[key], "piece_no": g.piece_no, "text_from": g.text_from, "tokens": g["size"], "container_from": first})

    return pieces.groupBy("spec_id", "shard").applyInPandas(one, f"spec_id string, container string, slot int, {key} long, piece_no int, text_from long, tokens int, container_from int")


def report(docs: DataFrame, specs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """(spec_id, rule, docs_most, attention_share, containers, pieces, tokens, capacity_tokens, most_docs, fill): how full the
    containers are under each rule, with the limits and, in the last of three rows, without."""
    out = None
    for rule, most, share in (("norm", DOCS_MOST, ATTENTION_SHARE), ("dot", DOCS_MOST, ATTENTION_SHARE), ("norm", 1 << 30, 1e9)):
        x = pack(docs, specs, key, most, share, rule, **options).groupBy("spec_id", "container").agg(F.count(F.lit(1)).alias("k"), F.sum("tokens").alias("t"))
        x = x.groupBy("spec_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("k").alias("pieces"), F.sum("t").alias("tokens"), F.max("k").alias("most_docs"))
        x = x.withColumns({"rule": F.lit(rule), "docs_most": F.lit(most), "attention_share": F.lit(share).cast("double")})
        out = x if out is None else out.unionByName(x)
    x = out.join(F.broadcast(specs.dropDuplicates(["spec_id"]).select("spec_id", "capacity_tokens")), "spec_id")  # plan table
    return x.select("spec_id", "rule", "docs_most", "attention_share", "containers", "pieces", "tokens", "capacity_tokens", "most_docs", F.try_divide(F.col("tokens"), F.col("containers") * F.col("capacity_tokens")).alias("fill"))
