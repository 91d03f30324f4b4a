"""Claim documents: validation, dependency cycles, and shuffled packets with new ids."""

from __future__ import annotations

import copy
import hashlib
import hmac
import json
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fields of a claim, and keys that tell where a text came from.
CLAIM_FIELDS = ("id", "subject", "predicate", "object", "qualifiers", "attribution", "modality", "polarity", "depends_on", "source_locator")
SOURCE_FIELDS = frozenset("source_text source_excerpt source_order source_url paragraph sentence_order style tone wording quote source_locator source_units".split())


def parse(raw: str):
    """JSON without repeated keys and without numbers that are not finite."""

    def pairs(items):
        out = dict(items)
        if len(out) < len(items):
            raise ValueError("duplicate key")
        return out

    def number(x: str) -> float:
        v = float(x)
        if not math.isfinite(v):
            raise ValueError("number not finite")
        return v

    return json.loads(raw, object_pairs_hook=pairs, parse_float=number, parse_constant=number)


def has_cycle(edges: dict[str, list[str]]) -> bool:
    """Whether dependencies run in a circle: walked depth first, a node met again while open closes one."""
    done: set[str] = set()
    for root in edges:
        if root in done:
            continue
        path, stack = {root}, [(root, iter(edges[root]))]
        while stack:
            node, rest = stack[-1]
            for nxt in rest:
                if nxt in path:
                    return True
                if nxt not in done and nxt in edges:
                    path.add(nxt)
                    stack.append((nxt, iter(edges[nxt])))
                    break
            else:
                stack.pop()
                path.discard(node)
                done.add(node)
    return False


def _text(x) -> bool:
    return isinstance(x, str) and bool(x.strip())


def _ids(x, known: set[str]) -> bool:
    return isinstance(x, list) and all(isinstance(i, str) for i in x) and len(set(x)) == len(x) and set(x) <= known


def entries(value):
    """Every (mapping, key) within a value, in no set order; what stands under a key named code is not entered."""
    todo = [value]
    while todo:
        node = todo.pop()
        if isinstance(node, list):
            todo += node
        elif isinstance(node, dict):
            for k in node:
                yield node, k
            todo += [v for k, v in node.items() if k != "code"]


def unfit(value, known: set[str]) -> str:
    """Why a claim's qualifiers do not do: they tell where a text came from, or name claims that are not there."""
    found = {k.replace("-", "_").replace(" ", "_").lower() for _, k in entries(value)} & SOURCE_FIELDS
    if found:
        return "source_metadata_in_claim"
    lost = any(k == "claim_id" and node[k] not in known or k == "claim_ids" and not _ids(node[k], known) for node, k in entries(value))
    return "unknown_reference" if lost else ""


def renamed(value, names: dict[str, str]):
    """A copy of the value whose references to claims bear the new names."""
    out = copy.deepcopy(value)
    for node, k in list(entries(out)):
        if k == "claim_id":
            node[k] = names[node[k]]
        elif k == "claim_ids":
            node[k] = [names[i] for i in node[k]]
    return out


def problems(doc) -> list[str]:
    """The rules a claim document breaks, each named once; an empty list is a valid document."""
    if not isinstance(doc, dict) or any(k not in doc for k in ("article_id", "language", "claims", "excluded", "coverage")):
        return ["structure"]
    out: list[str] = []
    say = lambda bad, name: out.append(name) if bad and name not in out else None
    claims = doc["claims"] if isinstance(doc["claims"], list) else []
    say(not claims, "no_claims")
    if any(not isinstance(c, dict) or set(CLAIM_FIELDS) - set(c) for c in claims):
        return [*out, "claim_fields"]
    ids = [c["id"] for c in claims]
    known = {i for i in ids if isinstance(i, str)}
    say(len(set(map(str, ids))) < len(ids), "duplicate_claim_id")
    for c in claims:
        say(set(c) - set(CLAIM_FIELDS) - SOURCE_FIELDS, "unknown_claim_field")
        say(not all(_text(c[k]) for k in ("id", "subject", "predicate", "object", "modality")), "empty_claim_text")
        say(not isinstance(c["qualifiers"], dict), "qualifiers")
        say(c["attribution"] is not None and not _text(c["attribution"]), "attribution")
        say(c["polarity"] not in ("positive", "negative"), "polarity")
        say(not _ids(c["depends_on"], known), "unknown_dependency")
        say(isinstance(c["depends_on"], list) and c["id"] in c["depends_on"], "self_dependency")
        found = unfit(c["qualifiers"], known)
        say(found, found)
    if not out:
        say(has_cycle({c["id"]: c["depends_on"] for c in claims}), "dependency_cycle")
    excluded = [x.get("id") for x in doc["excluded"] if isinstance(x, dict)] if isinstance(doc["excluded"], list) else []
    say(len(set(excluded)) < len(excluded) or set(excluded) & known, "duplicate_excluded_id")
    cover = doc["coverage"] if isinstance(doc["coverage"], dict) else {}
    units = cover.get("units") or []
    say(cover.get("uncovered_units") != [] or cover.get("scope") != "full_article" or not units, "coverage")
    places = [json.dumps(u.get("source_locator"), sort_keys=True) for u in units if isinstance(u, dict)]
    say(len(set(places)) < len(places), "duplicate_locator")
    seen = [i for u in units for k in ("claim_ids", "excluded_ids") for i in u.get(k, [])]
    say(any(not u.get("claim_ids") and not u.get("excluded_ids") for u in units), "unit_without_disposition")
    say(known - set(seen), "claims_not_covered")
    say(set(excluded) - set(seen), "exclusions_not_covered")
    say(set(seen) - known - set(excluded), "unknown_coverage_id")
    return out


def packet(doc: dict, seed: str) -> dict:
    """The document's claims under keyed ids, in keyed order, never in the order they came in, without their places."""
    mac = lambda *parts: hmac.new(seed.encode(), json.dumps([doc["article_id"], *parts], ensure_ascii=False).encode(), hashlib.sha256).hexdigest()
    names = {c["id"]: "c_" + mac("name", c["id"])[:20] for c in doc["claims"]}
    order = sorted(doc["claims"], key=lambda c: mac("order", c["id"]))
    if len(order) > 1 and order == doc["claims"]:
        order = order[1:] + order[:1]
    kept = [{k: names[c["id"]] if k == "id" else [names[i] for i in c[k]] if k == "depends_on" else renamed(c[k], names) for k in CLAIM_FIELDS if k != "source_locator"} for c in order]
    return {"packet_id": "p_" + mac("packet")[:20], "language": doc["language"], "claims": kept}


def checked(documents: DataFrame, key: str, raw: str, seed: str) -> DataFrame:
    """(key, problems, packet): the JSON documents validated; valid ones with their packet as JSON."""

    @F.pandas_udf("struct<problems: array<string>, packet: string>")
    def check(s: pd.Series) -> pd.DataFrame:
        out = []
        for r in s:
            try:
                doc = parse(r)
            except (ValueError, TypeError):
                out.append((["not_strict_json"], None))
                continue
            bad = problems(doc)
            out.append((bad, None if bad else json.dumps(packet(doc, seed), ensure_ascii=False)))
        return pd.DataFrame(out, columns=["problems", "packet"])

    return documents.select(key, check(F.col(raw)).alias("c")).select(key, "c.*")


def claim_documents(pairs: DataFrame) -> DataFrame:
    """(pair_id, raw): a claim document for each distinct answer row, its claims in a chain of dependencies.

    An answer without claim ids has no claims; ids that are unresolved are left out of the coverage.
    """
    p = pairs.select("pair_id", F.coalesce("claim_ids", F.array().cast("array<string>")).alias("ids"), F.coalesce("unresolved_claim_ids", F.array().cast("array<string>")).alias("open")).dropDuplicates(["pair_id"])
    s = lambda v: F.lit(v)
    claim = lambda i, n: F.struct(
        i.alias("id"), s("s").alias("subject"), s("p").alias("predicate"), i.alias("object"), F.create_map(s("n"), n.cast("string")).alias("qualifiers"), s(None).cast("string").alias("attribution"), s("stated").alias("modality"), s("positive").alias("polarity"),
        F.when(n > 0, F.array(F.get("ids", n - 1))).otherwise(F.array().cast("array<string>")).alias("depends_on"), n.cast("string").alias("source_locator"),
    )
    covered = F.array_except("ids", "open")
    unit = lambda i: F.struct(i.alias("source_locator"), F.array(i).alias("claim_ids"), F.array().cast("array<string>").alias("excluded_ids"))
    doc = F.struct(
        F.col("pair_id").alias("article_id"), s("en").alias("language"), F.transform("ids", claim).alias("claims"), F.array().cast("array<struct<id: string>>").alias("excluded"),
        F.struct(s("full_article").alias("scope"), F.transform(covered, unit).alias("units"), F.array().cast("array<string>").alias("uncovered_units")).alias("coverage"),
    )
    return p.select("pair_id", F.to_json(doc, {"ignoreNullFields": "false"}).alias("raw"))
