import re
from difflib import SequenceMatcher

from graphloom.functions import text as T
from graphloom.plans import queries as Q


def test_all_kinds_of_matches_against_brute_force(spark):
    """Entities that are matched by similarity count as matched, and not as novel."""
    sf = "/root/testdata/sf0.01"
    gold, found = (x.withColumn("key", T.normalize_hyphen(x.entity)).collect() for x in Q._named(spark, sf, Q.DOC))
    by, numbers = {}, lambda s: re.findall(r"\d+(?:\.\d+)?", s)
    for r in sorted(gold, key=lambda r: (r.ord, r.entity)):
        by.setdefault(r.p_brand, {}).setdefault(r.key, r.entity)
    matched, near, novel = set(), set(), set()
    for r in found:
        own = by.get(r.p_brand, {})
        if r.key in own:
            matched.add((r.p_brand, own[r.key]))
            continue
        score, best = min(((-SequenceMatcher(None, r.key, k).ratio(), k) for k in own), default=(0, ""))
        if -score >= 0.85 and numbers(best) == numbers(r.key):
            near.add((r.p_brand, own[best]))
        else:
            novel.add((r.p_brand, r.entity))
    assert near - matched
    classed = {(r.p_brand, r.entity, r["class"]) for r in gold}
    tp = sum((b, e) in matched | near for b, e, _ in classed)
    total = {r["class"]: r for r in Q.QUERIES["prf_all_strict"](spark, sf).collect()}[None]
    assert (total.tp, total.fn) == (tp, len(classed) - tp)
    assert {r["class"]: r for r in Q.QUERIES["prf_all_by_class"](spark, sf).collect()}[None].tp == tp
    rows = [(r.p_brand, r.entity) for r in Q.QUERIES["novel_entities_all"](spark, sf).collect()]
    assert len(rows) == len(novel) and set(rows) == novel
    new = {(r.p_brand, r.entity, r["class"]) for r in found if (r.p_brand, r.entity) in novel and len(r.entity) % 10 >= 7}
    assert {r["class"]: r for r in Q.QUERIES["prf_all_adjusted"](spark, sf).collect()}[None].novel == len(new)
    print("gold", len(classed), "matched exactly", len(matched), "by similarity beside", len(near - matched), "tp", tp, "novel", len(novel))
