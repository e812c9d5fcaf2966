"""Queries over texts that differ only after a long common beginning."""

import pytest

from lotwise.plans import registry

LEAD = "the same beginning of every text, " * 3


@pytest.fixture(scope="module")
def threads(spark, tmp_path_factory):
    """Thread 1 has copies that differ at the end only, thread 2 equal ones."""
    out = tmp_path_factory.mktemp("threads")
    rows = [(1, 1, "user", LEAD + "a"), (1, 2, "assistant", LEAD + "b"), (1, 4, "user", LEAD + "c"), (1, 5, "assistant", LEAD + "d")]
    rows += [(2, 1, "user", LEAD + "a"), (2, 2, "assistant", LEAD + "a")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{out}/conversations.parquet")
    return str(out)


def test_page_order_reads_whole_texts(spark, threads):
    got = {tuple(r) for r in registry.QUERIES["page_order"](spark, threads).select("grp", "pages", "copies", "verdict").collect()}
    assert got == {(1, 2, 2, "ambiguous"), (2, 1, 2, "agreed")}


def test_conversation_scope_keeps_whole_texts(spark, threads):
    got = {(r["conv_id"], r["turn"]): r["scope"] for r in registry.QUERIES["conversation_scope"](spark, threads).collect()}
    assert got == {(1, 1): LEAD + "a", (1, 2): LEAD + "a", (1, 4): LEAD + "c", (1, 5): LEAD + "c", (2, 1): LEAD + "a", (2, 2): LEAD + "a"}


def test_promote_lots_keeps_whole_texts(spark, threads):
    got = {(r["conv_id"], r["lot"]): (r["user"], r["assistant"]) for r in registry.QUERIES["promote_lots"](spark, threads).collect()}
    assert got == {(1, "1"): (LEAD + "a", LEAD + "b"), (1, "2"): (LEAD + "c", LEAD + "b"), (2, "1"): (LEAD + "a", LEAD + "a")}
