"""Searches by postings against scans, and folding, units, dates and pages."""

import random

import pytest
from pyspark.sql import functions as F

from tenet.functions import values
from tenet.operators import index, sync
from tenet.schema import conform
from tenet.sources.html import readable

WORDS = ["alpha", "beta", "betamax", "gamma", "Việt", "Việt", "crème", "x1", "delta"]


@pytest.fixture(scope="module")
def claims(spark):
    rng = random.Random(3)
    rows = [(f"00000000-0000-7000-8000-{i:012x}", f"s{i}", "SAYS", " ".join(rng.choice(WORDS) for _ in range(rng.randrange(7))), rng.choice([None, "a comment of alpha beta", ""])) for i in range(200)]
    return conform(spark.createDataFrame(rows, "tx string, subject string, verb string, value_text string, comment string"))


def by_columns(claims, tree):
    """The scan, column by column, for phrases that run across none."""
    def one(a):
        if not a.words:
            return F.lit(False)
        tests = [sync.spaced(F.col(c), True).contains(f" {' '.join(a.words)}" + ("" if a.open else " ")) for c in sync.SEARCHED]
        out = tests[0]
        for t in tests[1:]:
            out = out | t
        return out

    return sorted(r["id"] for r in claims.where(sync.judged(tree, one)).collect())


SEARCHES = ["alpha", "viet", '"alpha beta"', "bet*", "b*", '"alpha bet"*', "alpha NOT gamma", "(alpha OR gamma) AND NOT_there", "alpha gamma OR x1 NOT (delta OR beta)", '"beta beta"', "CRÈME", "---"]


def test_index_equals_scan(spark, claims, tmp_path):
    half = claims.where(F.col("tx") < "00000000-0000-7000-8000-000000000060")
    it = index.Index(spark, f"{tmp_path}/index").refresh(half).refresh(claims).refresh(claims)
    other = index.merged(it, f"{tmp_path}/other")
    for n, search in enumerate(SEARCHES):
        want = by_columns(claims, sync.parse_search(search))
        assert sorted(r["id"] for r in (it if n % 2 else other).search(search).collect()) == want, search


def test_index_reads_its_folders_alone(spark, claims, tmp_path):
    it = index.Index(spark, f"{tmp_path}/index").refresh(claims)
    plan = it.search("alpha AND delta")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters")[1][:200] and "BatchEvalPython" not in plan
    assert it.phrase("alpha beta").count() == it.search('"alpha beta"').count()
    assert index.Index(spark, f"{tmp_path}/none").search("alpha").count() == 0


def test_folding(spark):
    df = spark.createDataFrame([("Việt Nam",), ("Việt Nam",), ("Việt Nam",)], "t string")
    assert [r[0] for r in df.select(sync.has_phrase(F.col("t"), "viet nam", True)).collect()] == [True] * 3
    assert [r[0] for r in df.select(sync.has_phrase(F.col("t"), "vi")).collect()] == [False] * 3  # a letter and its mark are one


UNITS = {"USD/yr": True, "ms": True, "%": True, "m2": True, "req/s/core": True, "x-ray": False, "€": False, "m^2": False, "a/": False, "/s": False, "2x": False, "": False, "kW·h": False}
DATES = {"2026-04-10": True, "2026-04": True, "2026-Q1": True, "2026-H2": True, "2026-W53": True, "2025-W53": False, "2026-99": False, "2026-13": False, "2026-02-29": False, "2024-02-29": True, "2026-04-31": False, "2026": False, "2026-Q5": False, "2026-W00": False, "2026-99-99": False}


def test_units_and_dates(spark):
    import re

    assert {u: re.match(values.UNIT, u) is not None for u in UNITS} == UNITS
    assert {d: values.is_date(d) for d in DATES} == DATES
    rows = spark.createDataFrame([(d,) for d in DATES], "d string").select("d", values.date_column(F.col("d")).alias("is"))
    assert {r["d"]: r["is"] for r in rows.collect()} == DATES
    assert values.parse_value("5 x-ray").kind == "atom" and values.parse_value("5 m2").unit == "m2" and values.parse_value("2026-99-99").kind == "atom"


def test_pages():
    assert readable("<article><header><h1>Title</h1></header><p>Text</p></article>")[1] == "# Title\nText"
    assert readable("<body><div><form>Ask <p>one</p></div><p>two</p>")[1] == "Ask\none\ntwo"
    assert readable("<div><noscript>no</div><p>yes</p>")[1] == "yes"
    assert readable("<body><nav>Home</nav><script>var x = '<p>no</p>'</script><p>yes</p><template>t</template></body>")[1] == "Home\nyes"
