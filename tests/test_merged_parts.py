"""Flat parts of a merged index: each is made without the work of the others."""

from codefacts.operators import merge
from codefacts.plans import index
from codefacts.queries import merging


def test_forward_docs_are_gathered_once_and_only_where_they_are_shown(spark, sf_dir, monkeypatch):
    calls, offered = [], merge.offered_docs
    monkeypatch.setattr(merge, "offered_docs", lambda *a: calls.append(1) or offered(*a))
    assert "symbol" in merging.k02_document_occurrences(spark, sf_dir).columns and not calls
    s = merging.sym_raw(spark, sf_dir)
    parts = index.merged_parts(merging.occ_raw(spark, sf_dir), s.where("in_doc"), s.where("is_ext"), merging.rel_raw(spark, sf_dir), merging.fwd_raw(spark, sf_dir))
    assert set(parts) == set(index.FLAT) and len(calls) == 1


def test_resolving_reads_the_suffixes_once(spark, sf_dir):
    s = merging.sym_raw(spark, sf_dir)
    plan = merge.resolve(merging.fwd_raw(spark, sf_dir), s.where("in_doc"), s.where("is_ext"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_partkey") and sum("Relation" in line and "l_partkey" in line for line in plan.splitlines()) == 1
