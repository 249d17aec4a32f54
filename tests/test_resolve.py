import random

from evlake.operators import resolve

DEFS = "capture_id string, compiler_module string, raw_symbol string, start long, length long, kind string, target string"



def random_modules(seed, captures=30):
    """Definitions per capture: modules whose symbols are bodies or point anywhere, at random."""
    rng = random.Random(seed)
    out = []
    for c in range(captures):
        for m in range(rng.randrange(0, 4)):
            names = [f"s{i}" for i in range(rng.randrange(1, 9))]
            for at, name in enumerate(names):
                kind = rng.choice(["function", "direct_alias", "direct_alias", "direct_alias", "ifunc", "expression_alias"])
                target = rng.choice([*names, "elsewhere"]) if kind == "direct_alias" else None
                out.append((f"c{c}", f"unit{m}", name, 10 * at + m, 4, kind, target))
    return out


def plain_end(module, symbol):
    """(status, end, hops) of one symbol by following its aliases."""
    seen, at = [], symbol
    while True:
        if at not in module:
            return "no_exact_definition", None, len(seen)
        kind, target = module[at]
        if kind == "function":
            return "body", at, len(seen)
        if kind != "direct_alias":
            return "unsupported_alias", None, len(seen)
        if at in seen:
            return "alias_cycle", None, None
        seen.append(at)
        at = target


def test_bodies_and_outcomes(spark):
    rows = random_modules(8)
    captures = [f"c{i}" for i in range(30)]
    asked = [(c, i, f"s{i}") for c in captures for i in range(4)]
    lost = {"c3": "incremental", "c4": "incremental"}
    modules: dict[tuple, dict] = {}
    starts = {}
    for c, m, s, start, _, kind, target in rows:
        modules.setdefault((c, m), {})[s] = (kind, target)
        starts[c, m, s] = start
    definitions = spark.createDataFrame(rows, DEFS)
    instances = spark.createDataFrame(asked, "capture_id string, ordinal long, raw_symbol string")
    held = definitions.select("capture_id", "compiler_module").distinct().selectExpr(
        "*", "7L as artifact_id", "'no_lto_optimized' as stage"
    )
    uncollected = spark.createDataFrame(list(lost.items()), "capture_id string, not_captured_reason string")
    bodies = resolve.symbol_bodies(instances, definitions, held)
    got = {(r.capture_id, r.ordinal): (r.outcome, r.bodies) for r in resolve.evidence_outcome(instances, bodies, not_captured=uncollected).collect()}
    found, hops = {}, {}
    for c, i, symbol in asked:
        ends = {m: plain_end(defs, symbol) for (cc, m), defs in modules.items() if cc == c}
        found[c, i] = sorted((m, e[1]) for m, e in ends.items() if e[0] == "body")
        hops |= {(c, i, m): e[2] for m, e in ends.items() if e[0] == "body"}
        if c in lost:
            assert got[c, i][0] == "not_captured"
        elif any(e[0] == "alias_cycle" for e in ends.values()):
            # A cycle is damage, whatever other modules hold.
            assert got[c, i][0] == "alias_cycle"
        elif found[c, i]:
            assert got[c, i] == ("available", len(found[c, i]))
        else:
            assert got[c, i][1] == 0 and got[c, i][0] in {e[0] for e in ends.values()} | {"no_exact_definition"}
    ordered = resolve.order_bodies(bodies, ["capture_id", "ordinal"]).collect()
    per: dict[tuple, list] = {}
    for r in ordered:
        assert r.start == starts[r.capture_id, r.compiler_module, r.body_symbol]
        assert r.hops == hops[r.capture_id, r.ordinal, r.compiler_module]
        per.setdefault((r.capture_id, r.ordinal), []).append((r.compiler_module, r.body_symbol))
    assert {k: v for k, v in per.items() if k[0] not in lost} == {k: v for k, v in found.items() if v and k[0] not in lost}


def test_chains_deeper_than_a_hundred(spark):
    n = 300
    chain = [("c", "m", f"s{i}", i, 1, "direct_alias", f"s{i + 1}") for i in range(n)]
    chain.append(("c", "m", f"s{n}", n, 1, "function", None))
    ring = [("c", "r", f"s{i}", i, 1, "direct_alias", f"s{(i + 1) % 150}") for i in range(150)]
    tail = [("c", "r", f"t{i}", i, 1, "direct_alias", "t0" if i == 0 else f"s{i}") for i in range(1, 5)]
    states = resolve.resolve_aliases(spark.createDataFrame(chain + ring + tail, DEFS)).collect()
    got = {(r.compiler_module, r.symbol): (r.status, r.end, r.hops) for r in states}
    for i in range(n + 1):
        assert got[("m", f"s{i}")] == ("body", f"s{n}", n - i)
    assert {v for k, v in got.items() if k[0] == "r"} == {("alias_cycle", None, None)}


def test_references(spark):
    capture = "z" * 31 + "y"
    rows = spark.createDataFrame([(capture, i, f"i{i}") for i in range(2)], "capture_id string, ordinal long, name string")
    texts = {f"{capture}:0": "found", f"{capture}:1": "found", f"{capture}:2": "invalid_ordinal",
             f"{capture}:18446744073709551615": "invalid_ordinal", "z" * 32 + ":0": "unknown_capture"}
    for suffix in ("", "00", "01", "+1", "-1", " 1", "1 ", "1:2", "18446744073709551616", "1\n"):
        texts[f"{capture}:{suffix}"] = "malformed"
    texts["short:0"] = "malformed"
    asked = spark.createDataFrame([(t,) for t in texts], "reference string")
    got = resolve.resolve_references(asked, "reference", rows).collect()
    assert {r.reference: r.status for r in got} == texts
