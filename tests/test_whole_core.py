"""Cases where the core queries once did less than the whole job."""

import random

from corpusloom.operators import sampling
from corpusloom.plans import catalog

QUEUE = "place long, record_id string, selected_hash string, original_hash string, doc_id string"


def loop(rows):
    ids, sel, orig, docs, out = set(), set(), set(), set(), {}
    for p, r, s, o, d in rows:
        why = "record_id_already_selected" if r in ids else "selected_text_duplicate_across_queue" if s in sel | orig else "original_input_duplicate_across_queue" if o in sel | orig else "document_already_selected" if d is not None and d in docs else "taken"
        out[p] = why
        if why == "taken":
            ids.add(r), sel.add(s), orig.add(o), docs.add(d)
    return out


def test_hot_documents_and_chains(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, f"r{rng.randrange(900)}", f"t{rng.randrange(900)}", f"t{rng.randrange(900)}", rng.choice(["hot", "", None, f"d{i}"])) for i in range(600)]
    df = spark.createDataFrame(rows, QUEUE)
    assert {r.place: r.outcome for r in sampling.greedy_queue(df).collect()} == loop(rows)
    chain = [(i, f"c{i}", f"u{i}", f"u{i + 1}", None) for i in range(40)]
    assert {r.place: r.outcome for r in sampling.greedy_queue(spark.createDataFrame(chain, QUEUE)).collect()} == loop(chain)
    monkeypatch.setattr(sampling, "_by_groups", None)  # a hot document alone never comes to the loop
    hot = [(i, f"r{i}", f"t{i}", f"t{i}", "hot") for i in range(300)]
    assert {r.place: r.outcome for r in sampling.greedy_queue(spark.createDataFrame(hot, QUEUE)).collect()} == loop(hot)


def test_registered_queue_has_the_document_rule(spark, sf):
    out = {r.outcome: r["count"] for r in catalog.queries()["greedy_dedup_queue"](spark, sf).groupBy("outcome").count().collect()}
    assert out["document_already_selected"] > 0 and sum(out.values()) == spark.read.parquet(f"{sf}/records.parquet").where("text is not null").count()
