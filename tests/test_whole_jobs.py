"""Registered queries over whole inputs, held against brute force on small fixtures."""

import difflib
import re

from tracemill.functions import text as T
from tracemill.plans import catalog
from test_queries import SF, pytestmark  # noqa: F401


def phrases(text, most=14):
    kept = {}
    for part in re.split(T.BREAKS, re.sub(r"https?://\S+", " ", text)):
        for p in re.findall(T.PHRASE, part):
            p = re.sub(r"^[ \-–—.'’]+|[ \-–—.'’]+$", "", p)
            proper = [w for w in p.split(" ") if len(w) >= 3 and re.sub(r"^[.'’-]+|[.'’-]+$", "", w.lower()) not in T.GENERIC_WORDS]
            if len(p) >= 3 and proper:
                kept.setdefault(p.lower(), p)
    return list(kept.values())[:most]


def test_place_phrases_after_the_first_400_characters(spark, tmp_path):
    texts = ["x" * 500 + ", Ulm, Neu Ulm to Berlin", "word " * 9000 + "via Kempten; KEMPTEN then Lindau", "Ulm, " * 300 + "Augsburg", "none here", ", ".join("Town%s" % c for c in "abcdefghijklmnopqrst")]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.phrases for r in catalog.queries()["t07_place_phrases"](spark, str(tmp_path)).collect()}
    assert found == {i: p for i, p in enumerate(map(phrases, texts)) if p}
    assert found[0] == ["Ulm", "Neu Ulm", "Berlin"] and found[1] == ["Kempten", "Lindau"] and len(found[4]) == 14


def test_fuzzy_streets_of_all_words_whatever_the_first_letter(spark, tmp_path):
    docs = ["der die das und ein aus bei mit Kaiser caiser akaiser", "one two three four five six seven eight lavendar Xlavender", "Blanched blanchedalmonds khaki akhik", "", "ab-c d'e 12345 almnod"]
    parts = ["lavender kaiser", "almond blanched", "khaki steel"]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(parts)), "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    names = {n for p in parts for n in p.split() if len(n) >= 4}
    expected = {}
    for i, d in enumerate(docs):
        for w in {w.lower() for w in d.split() if len(w) >= 4}:
            r, n = max((round(difflib.SequenceMatcher(None, w, n).ratio(), 6), n) for n in names)
            if r >= 0.85:
                expected[i, w] = (n, r)
    found = {(r.doc_id, r.w): (r.name, r.ratio) for r in catalog.queries()["j14_fuzzy_streets"](spark, str(tmp_path)).collect()}
    assert found == expected
    assert found[1, "lavendar"][0] == found[1, "xlavender"][0] == "lavender" and found[0, "akaiser"][0] == "kaiser"


def test_whole_tracks_are_folded(spark):
    points = spark.read.parquet(f"{SF}/events.parquet")
    for name in ("o10_leader_clusters", "p09_elastic_fusion"):
        assert catalog.queries()[name](spark, SF).count() == points.count()
    assert catalog.queries()["p04_viterbi"](spark, SF).count() == points.count()
    most = points.groupBy("user_id").count().agg({"count": "max"}).first()[0]
    assert catalog.queries()["x21_extrude"](spark, SF).groupBy("user_id").count().agg({"count": "max"}).first()[0] > 2 * most
