import json

from tessella.config import Config
from tessella.operators import provider
from tessella.plans import routing_extraction as R

LINES = ["Q1. Do you own a farm?", "Q2. How large is it?", "Q3. Who works there?", "Q4. Do you rent land?"]


def answering(spoil: bool = False):
    """Each question leads to the next; Q1 also jumps to Q4, and Q4 to one that isn't there."""
    quotes = {f"q{n}": line for n, line in enumerate(LINES, 1)}
    jump = ("q1", "q4", "conditional", json.dumps({"op": "equals", "item": "q1", "value": {"t": "str", "s": "n"}}))
    nexts = {"q1": "q2", "q2": "q3", "q3": "q4"}

    def answers(message: str) -> dict:
        asked = json.loads(message)
        if asked["pass_kind"] == "forward":
            said = [(a, nexts[a], "sequential", None) for a in asked["items"] if a in nexts] + [jump, ("q4", "q9", "sequential", None)]
        else:
            said = [jump] if "q4" in asked["items"] else []
        evidence = [{"local_id": str(n), "source": s, "target": t, "kind": k, "condition": c, "block_id": f"block-00000{s[1]}", "quote": "nobody said so" if spoil else quotes[s], "confidence": 0.9} for n, (s, t, k, c) in enumerate(said)]
        return {"chunk_id": asked["chunk_id"], "pass_kind": asked["pass_kind"], "examined": asked["items"], "unresolved": [], "evidence": evidence}

    return answers


def blocks_of(spark):
    rows = [("d", f"block-{n:06d}", n - 1, line, None, None, None) for n, line in enumerate(LINES, 1)]
    return spark.createDataFrame(rows, "doc_id string, block_id string, ord int, text string, page int, pages array<int>, table_rows array<array<string>>")


def test_two_passes(spark):
    blocks = blocks_of(spark)
    out = R.extract_routing(R.question_inventory(blocks), blocks, provider.rule_provider(answering()), Config())
    edges = {(r.source, r.target, r.kind) for r in out["edges"].collect()}
    node = lambda n: f"question:root:q{n}"
    assert edges == {(node(1), node(2), "sequential"), (node(2), node(3), "sequential"), (node(3), node(4), "sequential"), (node(1), node(4), "conditional")}
    lost = out["candidates"].collect()
    assert [(r.source, r.target, r.issues) for r in lost] == [(node(4), "ref:q9", ["unresolved_target"])]
    targets = {r.node: r.reasons for r in out["targets"].collect()}
    assert targets == {node(2): ["branch_target"], node(4): ["unresolved_target", "branch_target"]}
    calls = {r.chunk_id: r.ok for r in out["calls"].collect()}
    assert calls == {"forward-000001": True, "incoming_activation-000001": True}


def test_a_part_with_a_wrong_quote_fails_as_a_whole(spark):
    blocks = blocks_of(spark)
    out = R.extract_routing(R.question_inventory(blocks), blocks, provider.rule_provider(answering(spoil=True)), Config())
    assert out["edges"].count() == 0
    assert [(r.chunk_id, r.ok, r.reason) for r in out["calls"].collect()] == [("forward-000001", False, "not_found")]
