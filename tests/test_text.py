import hashlib

import pytest
from pyspark.sql import functions as F

from strata.functions import text as tx


@pytest.mark.parametrize(
    "sql, expected",
    [
        ("SELECT 1", "select 1"),
        ("SELECT *\n FROM   users\t WHERE id=1 ;;;", "select * from users where id=1 "),
        ("/* a\n b */SELECT -- tail\n 1", "select 1"),
        ("-- only a comment", ""),
        ("   ", ""),
        ("", ""),
        ("SELECT 'a--b' FROM t", "select 'a"),
        ("SELECT 1 ﻿+　2;", "select 1 + 2"),
        ("select 1; ;", "select 1; "),
    ],
)
def test_canonical_sql(one, sql, expected):
    assert one(tx.canonical_sql, sql) == expected
    assert one(tx.sql_hash, sql) == hashlib.sha256(expected.encode()).hexdigest()


def test_same_query_same_hash(one):
    a = one(tx.sql_hash, "SELECT id FROM t -- x")
    assert a == one(tx.sql_hash, "select  ID\nfrom T;")
    assert a != one(tx.sql_hash, "SELECT id FROM u")


@pytest.mark.parametrize("name, expected", [("a-b c", "a_b_c"), ("x\U0001f600y", "x__y"), ("é", "_"), ("ok_1", "ok_1")])
def test_sanitize_identifier(one, name, expected):
    assert one(tx.sanitize_identifier, name) == expected


@pytest.mark.parametrize(
    "name, expected",
    [("My  Table", "my_table"), ("--a--b--", "_a_b_"), ("-x-", "x"), ("A/B.C", "a_b_c"), ("a - b", "a_-_b")],
)
def test_slugify(one, name, expected):
    assert one(tx.slugify, name) == expected


def test_sanitize_filename(one):
    assert one(tx.sanitize_filename, 'a/b\\c?d%e*f:g|h"i<j>k') == "a_b_c_d_e_f_g_h_i_j_k"


@pytest.mark.parametrize(
    "sql, expected",
    [
        ("-- Title here \nSELECT 1", "Title here"),
        ("\n\n  --No blank\r\nSELECT", "No blank"),
        ("--\nSELECT 1", None),
        ("SELECT 1 -- no", None),
        ("/* no */", None),
        ("", None),
    ],
)
def test_query_title(one, sql, expected):
    assert one(tx.query_title, sql) == expected


NOTE = """---
title: "Quoted title"
tags: [alpha, 'beta', , "gamma"]
connection: main db
---
# Head *bold*
body"""


def test_front_matter_inline(one):
    m = one(tx.front_matter, NOTE)
    assert m.title == "Quoted title"
    assert m.tags == ["alpha", "beta", "gamma"]
    assert m.connection_name == "main db"
    assert m.connection_id is None and m.dialect is None
    assert one(lambda c: tx.body_normalize(tx.note_body(c)), NOTE) == "Head bold\nbody"
    assert one(lambda c: tx.body_summary(tx.note_body(c)), NOTE) == "Head bold"


def test_front_matter_dash_list(one):
    note = "---\ntags:\n  - one\n  - 'two'\n  plain\ndialect: spark\n  - late\n---\nx"
    m = one(tx.front_matter, note)
    assert m.tags == ["one", "two"]
    assert m.dialect == "spark"


@pytest.mark.parametrize("note", ["---\ntitle: open", "no head", "---", ""])
def test_front_matter_absent(one, note):
    m = one(tx.front_matter, note)
    assert m.title is None and m.tags is None
    assert one(tx.note_body, note) == note


def test_empty_tag_list_is_none(one):
    assert one(tx.front_matter, "---\ntags: []\n---\n").tags is None


def test_body_normalize(one):
    assert one(tx.body_normalize, "## A\r\n\r\n\r\n\r\n`b` ~c~ _d_\n") == "A\n\nb c d"


def test_body_summary_is_cut(one):
    assert one(tx.body_summary, "\n---\n" + "x" * 201) == "x" * 200 + "..."
    assert one(tx.body_summary, "x" * 200) == "x" * 200
    assert one(tx.body_summary, "\n \n") is None


def test_snippet(one):
    text = "a" * 100 + " Needle\n here " + "b" * 100
    found = one(lambda c: tx.snippet(c, F.lit("needle")), text)
    assert found == "..." + "a" * 79 + " Needle here " + "b" * 73 + "..."
    assert one(lambda c: tx.snippet(c, F.lit("absent")), text) is None
    assert one(lambda c: tx.snippet(c, F.lit("x")), "x") == "x"


def test_labels(one):
    assert one(tx.truncate_label, " a \n b ") == "a b"
    assert one(tx.truncate_label, "y" * 51) == "y" * 50 + "..."
    assert one(tx.edge_label, "z" * 20) == "z" * 20
    assert one(tx.edge_label, "z" * 21) == "z" * 19 + "..."


@pytest.mark.parametrize(
    "sql, expected",
    [("select 1", True), (" WITH x AS", True), ("values (1)", True), ("selection", False), ("INSERT INTO t", False), ("explain x", True)],
)
def test_is_result_statement(one, sql, expected):
    assert one(tx.is_result_statement, sql) is expected


def test_is_ddl_statement(one):
    assert one(tx.is_ddl_statement, "select 1; DROP table x")
    assert not one(tx.is_ddl_statement, "select dropped from x")
    assert not one(tx.is_ddl_statement, "écreate")


@pytest.mark.parametrize(
    "sql, expected",
    [
        ("SELECT 1 LIMIT 10", 10),
        ("SELECT 1 limit 10 offset 5 ; ", 10),
        ("SELECT 1 LIMIT 10 -- x", None),
        ("SELECT * FROM (SELECT 1 LIMIT 3) t", None),
        ("SELECT 1", None),
    ],
)
def test_existing_limit(one, sql, expected):
    assert one(tx.existing_limit, sql) == expected


def test_history_schema(one):
    assert one(tx.history_schema, "select * from Sales.t join x.y") == "Sales"
    assert one(tx.history_schema, "select 1") == "main"


def test_search_tokens(one):
    assert one(tx.search_tokens, 'Foo "Bar Baz"  "" "open') == ["foo", "bar baz", '""', '"open']
