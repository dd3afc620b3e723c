import regex
from pyspark.sql import functions as F

from trajmill import constants as C
from trajmill.functions import arrays as A, numbers as N, text as X
from trajmill.functions.sql import register_sql_functions

RULES = [*X.home_rules("ada"), X.host_rule("registry.example.org"), X.ENDPOINT_RULE]


def one(spark, column, *values, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r.out for r in df.select(column(F.col("v")).alias("out")).collect()]


def test_redaction_rules_apply_in_order(spark):
    got = one(
        spark,
        lambda v: X.redact(v, RULES),
        "see /fast/ada/x/y.txt and '/home/ada/z'",
        "/lustre/home/ada/secret end",
        "/home/bob/keep /home/ada/",
        "registry.example.org/img registryXexample.org",
        "http://node-12:8000/v1/models http://node:80/v2",
        None,
    )
    assert got == [
        "see /fast/<user>/<redacted> and '/home/<user>/<redacted>'",
        "/lustre/home/<user>/<redacted> end",
        "/home/bob/keep /home/<user>/<redacted>",
        "<internal-registry>/img registryXexample.org",
        "http://<vllm-host>/v1/models http://node:80/v2",
        None,
    ]


def test_labels_are_literal(spark):
    assert one(spark, lambda v: X.redact(v, [(r"\d+", r"$1\2")]), "a1b") == [r"a$1\2b"]


def test_messages(spark):
    df = spark.createDataFrame([([("user", "/home/ada/a"), (None, None)],), (None,)], "m array<struct<role:string,content:string>>")
    got = [r.out for r in df.select(X.redact_messages(F.col("m"), RULES).alias("out")).collect()]
    assert [[tuple(m) for m in row] for row in got] == [[("user", "/home/<user>/<redacted>"), ("", "")], []]


def test_names(spark):
    assert one(spark, X.repo, "django__django-7530", "scikit-learn__scikit-learn-1", "plain", "a__b__c") == ["django", "scikit-learn", "plain", "a"]
    assert one(spark, X.run_tag, "/x/web-pass3-run2", "plain") == ["run2", "plain"]


def test_elision(spark):
    short, exact, long = "x" * 9999, "é" * 10000, "a" * 5000 + "b" * 300 + "c" * 5000
    got = one(spark, X.elide, short, exact, long)
    assert got[0] == f"<output>\n{short}\n</output>"
    assert "0 characters elided" in got[1] and got[1].count("é") == 10000
    assert "300 characters elided" in got[2] and "b" not in got[2].split("<output_head>")[1].split("</output_head>")[0]
    assert got[2].endswith("c" * 5000 + "\n</output_tail>")


def test_actions(spark):
    two = "THOUGHT\n```bash\nls\n```\nand\n```bash\ncd x && \nls\n```"
    assert one(spark, X.action_count, "none", "a\n```bash\nls -la\n```", two, "```python\nx\n```") == [0, 1, 2, 0]
    assert one(spark, X.is_valid_action, "none", "```bash\nls\n```", two) == [False, True, False]


def test_pieces_equal_the_regex_module(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts += ["It's  we'LL   x\r\n\r\n 12345 ¿qué? ÀÉ漢字 \t\n", "   ", "áb", ""]
    for text, pieces in zip(texts, one(spark, X.pretokenize, *texts)):
        assert pieces == regex.findall(C.PRETOKEN_PATTERN, text)
        assert "".join(pieces) == text


def test_sizes_and_patches(spark):
    assert one(spark, lambda v: X.text_size(v), "é") == [1] and one(spark, lambda v: X.text_size(v, "bytes"), "é") == [2]
    assert one(spark, X.is_patch, "diff --git a/x", "", None, " diff --git") == [True, False, False, False]
    assert one(spark, X.patch_files, "diff --git a/x.py b/x.py\n+1\ndiff --git a/t/y.py b/t/y.py") == [["x.py", "t/y.py"]]


def test_numbers(spark):
    assert one(spark, lambda v: N.budget(v, (2, 5)), 11, 0, 10**15 + 3, kind="bigint") == [4, 0, (10**15 + 3) * 2 // 5]
    assert one(spark, lambda v: N.percent(v, 0), 3, kind="int") == [300.0]
    df = spark.createDataFrame([("2026-01-01 10:00:00", "2026-01-01 11:30:00"), ("2026-01-01 10:00:00", "2026-01-01 09:00:00"), ("x", "2026-01-01 09:00:00")], "a string, b string")
    got = df.select(N.log_time(F.col("a")).isNull().alias("bad"), N.elapsed_seconds(N.log_time(F.col("a")), N.log_time(F.col("b"))).alias("s")).collect()
    assert [(r.bad, r.s) for r in got] == [(False, 5400), (False, 0), (True, 0)]


def test_special_tokens(spark):
    assert one(spark, A.special_token_id, "<|end|>", "<|system|>", "nothing") == [65536, 65539, None]


def test_norms(spark):
    got = one(spark, lambda v: A.norm_state(A.l2_norm(v)), [0.1, 0.1], [3.0, 4.0], [0.3, 0.4], kind="array<float>")
    assert got == ["collapsed", "healthy", "between"]


def test_sql_functions(spark):
    register_sql_functions(spark, RULES)
    r = spark.sql("SELECT repo_of('a__b') r, run_tag_of('x-run3') t, redacted('/home/ada/q it\\'s') d, elided('ok') e").first()
    assert (r.r, r.t, r.d, r.e) == ("a", "run3", "/home/<user>/<redacted> it's", "<output>\nok\n</output>")
    long = "z" * 12000
    df = spark.createDataFrame([(long,)], "v string")
    assert df.selectExpr("elided(v) e").first().e == one(spark, X.elide, long)[0]
