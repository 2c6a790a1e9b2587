"""SQL texts by tokens."""

import random
import time

import pytest

from veilmark.operators.sqltext import DIALECTS, lexer, mask_sql, masked_sql, sql_strings, sql_tokens

MASKS = {("table", "job_postings"): "T1", ("table", "mart_ghost_index"): "T2", ("schema", "acme"): "S1", ("column", "ghost_probability"): "C1", ("column", "status"): "C9", ("alias", "median_ghost"): "A1", ("alias", "feed"): "A2"}


def test_tokens_join_to_the_text():
    draw = random.Random(5)
    parts = ["select ", "'it''s'", '"a""b"', "`x`", "[y]", "--c\n", "/* a /* b */ c */", "$t$ '' $t$", "$$", "'", '"', "\\", "#h\n", "E'\\''", "1.5e3", "é_1", "(", ")", ".", "\n", "/*", "N'x'"]
    for dialect in DIALECTS:
        for _ in range(400):
            text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 9)))
            assert "".join(t.text for t in sql_tokens(text, dialect)) == text
            assert masked_sql(text, {}, {}, dialect, keep_comments=True) == text


@pytest.mark.parametrize(
    "sql, want, dialect",
    [
        ("SELECT p.ghost_probability AS gp FROM acme.job_postings p", "SELECT p.C1 AS gp FROM S1.T1 p", "ansi"),
        ("WITH feed AS (SELECT 1 FROM job_postings, acme . mart_ghost_index) SELECT ghost_probability median_ghost FROM feed ORDER BY median_ghost", "WITH A2 AS (SELECT 1 FROM T1, S1 . T2) SELECT C1 A1 FROM A2 ORDER BY A1", "ansi"),
        ("WITH job_postings (a) AS (SELECT 1) SELECT * FROM job_postings", "WITH job_postings (a) AS (SELECT 1) SELECT * FROM job_postings", "ansi"),
        ("SELECT job_postings.status FROM job_postings WHERE job_postings = 'job_postings'", "SELECT T1.C9 FROM T1 WHERE job_postings = 'job_postings'", "ansi"),
        ("SELECT status(x), extract(year FROM status), a IS DISTINCT FROM status FROM job_postings", "SELECT status(x), extract(year FROM C9), a IS DISTINCT FROM C9 FROM T1", "ansi"),
        ('SELECT "status", "ghost_probability" FROM "acme"."job_postings"', 'SELECT "C9", "C1" FROM "S1"."T1"', "postgres"),
        ("SELECT `status` FROM `acme`.`job_postings`", "SELECT `C9` FROM `S1`.`T1`", "mysql"),
        ("SELECT [status] FROM [acme].[job_postings]", "SELECT [C9] FROM [S1].[T1]", "tsql"),
        ("SELECT 1 -- acme\n, 2 /* acme /* x */ don't */ FROM job_postings", "SELECT 1 \n, 2   FROM T1", "postgres"),
        ("SELECT/* a */status FROM job_postings-- end", "SELECT C9 FROM T1", "ansi"),
        ("SELECT 'Acme''s', E'Acme\\'s', $x$Acme's$x$, 'other' FROM t", "SELECT 'L''1', E'L''1', $x$L'1$x$, 'other' FROM t", "postgres"),
        ("SELECT 'Acme\\'s', \"Acme's\" FROM t", "SELECT 'L''1', \"L'1\" FROM t", "mysql"),
        ("UPDATE job_postings SET status = 'x' WHERE status IN (SELECT status FROM mart_ghost_index)", "UPDATE T1 SET C9 = 'x' WHERE C9 IN (SELECT C9 FROM T2)", "ansi"),
        ("INSERT INTO acme.job_postings (status) VALUES (1)", "INSERT INTO S1.T1 (C9) VALUES (1)", "ansi"),
        ("SELECT * FROM (SELECT * FROM job_postings) x JOIN mart_ghost_index ON x.status = mart_ghost_index.status", "SELECT * FROM (SELECT * FROM T1) x JOIN T2 ON x.C9 = T2.C9", "ansi"),
    ],
)
def test_masked(sql, want, dialect):
    assert masked_sql(sql, MASKS, {"Acme's": "L'1"}, dialect) == want


def test_long_texts():
    n = 200_000
    for text in ("/*" * n, "'" * (n + 1), "$a$" + "x" * n, "(" * n, "a." * n, "-- " * n, "/* * / " * (n // 4), '"' + "a" * n, ")" * n, "select " * (n // 7)):
        for dialect in ("postgres", "mysql"):
            began = time.time()
            masked_sql(text, MASKS, {}, dialect)
            assert time.time() - began < 8, text[:9]


def test_rows(spark):
    df = spark.createDataFrame([(1, "SELECT status FROM job_postings WHERE a = 'x'"), (2, "SELECT status FROM job_postings WHERE a = 'x'"), (2, None), (3, ""), (None, "SELECT 'x'")], "id int, sql string")
    masks = spark.createDataFrame([(1, "table", "job_postings", "T1"), (1, "column", "status", None), (2, "column", "status", "C9")], "scope int, kind string, name string, mask string")
    literals = spark.createDataFrame([("x", "L1"), ("y", "L2")], "value string, mask string")
    got = sorted(map(tuple, mask_sql(df, "id", "sql", masks, literals).collect()), key=str)
    assert got == sorted([(1, "SELECT status FROM T1 WHERE a = 'L1'"), (2, "SELECT C9 FROM job_postings WHERE a = 'L1'"), (2, None), (3, ""), (None, "SELECT 'L1'")], key=str)
    scoped = literals.selectExpr("1 AS scope", "*")
    assert sorted(r["sql"] or "" for r in mask_sql(df, "id", "sql", masks, scoped).collect()) == sorted(["SELECT status FROM T1 WHERE a = 'L1'", "SELECT C9 FROM job_postings WHERE a = 'x'", "", "", "SELECT 'x'"])
    assert sorted(map(tuple, sql_strings(df.where("id = 1"), "id", "sql").collect())) == [(1, "x")]
    with pytest.raises(ValueError):
        mask_sql(df, "id", "sql", masks, dialect="other")


def test_runs_skip_no_string():
    """The pattern that takes other tokens in runs finds the strings that all tokens have."""
    draw = random.Random(6)
    parts = ["a", "n", "e", "r'x'", "N'x'", "E'\\''", "U&'x'", '"y"', "`", "[y]", "'", "$t$", "$", "--", "-", "/*", "*/", "/", "#", "\n", " ", "_1", "٣", "é", "(", "."]
    for dialect in DIALECTS:
        runs = lexer(dialect, for_strings=True)
        for _ in range(400):
            text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 12)))
            assert [t.value for t in sql_tokens(text, dialect, runs) if t.kind == "string"] == [t.value for t in sql_tokens(text, dialect) if t.kind == "string"], text


def test_statements_are_read_once(spark):
    """Their numbers join two branches, so both must see the same rows; before, each branch read them anew."""
    seen = spark.sparkContext.accumulator(0)

    def counted(n):
        seen.add(1)
        return (n, f"SELECT 'x{n}'")

    df = spark.createDataFrame(spark.sparkContext.parallelize(range(40), 2).map(counted), "id int, sql string")
    masks = spark.createDataFrame([], "scope int, kind string, name string, mask string")
    literals = spark.createDataFrame([(f"x{n}", f"L{n}") for n in range(0, 80, 2)], "value string, mask string")
    got = dict(map(tuple, mask_sql(df, "id", "sql", masks, literals).collect()))
    assert got == {n: f"SELECT '{'x' if n % 2 else 'L'}{n}'" for n in range(40)} and seen.value == 40
