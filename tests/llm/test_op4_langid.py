import math
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import op4_langid
from tessera.llm.op4_langid import SuffixAutomaton


@given(st.text("ab c", min_size=1, max_size=60), st.text("abcd", max_size=30))
@settings(max_examples=200, deadline=None)
def test_phrases_are_longest_matches(sample, word):
    count, rest = 0, word
    while rest:
        k = max((k for k in range(1, len(rest) + 1) if rest[:k] in sample), default=1)
        count, rest = count + 1, rest[k:]
    assert SuffixAutomaton(sample).phrases(word) == count


def test_held_out_accuracy(spark, sf_dir):
    got = op4_langid.op4_langid(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) >= 200 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_odd_texts(spark):
    rows = [(i, "the cat sat on the mat", "en", 1) for i in range(20)] + [(100 + i, "die katze sitzt auf der matte", "de", 2) for i in range(20)]
    learnt = op4_langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string, x int"))
    odd = [(1, None, "q"), (2, "", "q"), (3, "123 !?", None), (4, "the mat " * 20000, "q"), (None, "auf der katze", "q"), (4, "x", "q")]
    got = op4_langid.identify(spark.createDataFrame(odd, "doc_id long, text string, extra string"), learnt).collect()
    assert [(r["lang_pred"]) for r in got][:5] == ["und", "und", "und", "en", "de"] and [r["score"] for r in got][:3] == [0, 0, 0] and got[0]["extra"] == "q"
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert op4_langid.learn(empty) == {} and op4_langid.identify(empty, {}).count() == 0
    assert op4_langid.identify(spark.createDataFrame(odd, "doc_id long, text string, extra string"), {}).where("lang_pred <> 'und'").count() == 0


def test_ties_and_unknown_letters():
    parser = op4_langid.CrossParser({"b": "aaa", "a": "aaa"})
    assert [x[0] for x in parser.predict(["aa", "ζζ"])] == ["a", "a"]


def brute(samples, text):
    """Language, score and bits a letter by the definition, phrase by phrase."""
    whole = " ".join(re.findall(r"[^\W\d_]+", (text or "").lower()))
    n, bits = len(whole.replace(" ", "")), {}
    for lang in sorted(samples):
        count = 0
        for start in range(0, len(whole), op4_langid.PIECE):
            rest = whole[start : start + op4_langid.PIECE]
            while rest:
                k = 1
                while k < len(rest) and rest[: k + 1] in samples[lang]:
                    k += 1
                count, rest = count + 1, rest[k:]
        bits[lang] = count * math.log2(max(2, len(samples[lang]))) / max(1, n)
    best = min(sorted(bits), key=bits.get)
    stretch = 16 * n / (n + 16)
    return (best, 1 / sum(2 ** ((bits[best] - b) * stretch) for b in bits.values()), bits[best]) if n else ("und", 0.0, 0.0)


def test_predictions_against_brute_force(monkeypatch):
    samples = {"x": "the cat sat on the mat\nand then it slept", "y": "die katze sass auf der matte\nund schlief dann", "z": "le chat dort là"}
    r = random.Random(4)
    texts = ["", None, "1 2", "The CAT, sat!", "é", "matte der katze", "là-bas le chat", "ß9x"] + ["".join(r.choice("the catmis onduf  .1ßé") for _ in range(r.randrange(300))) for _ in range(60)]
    for piece, table in ((1024, 1 << 24), (7, 1 << 24), (1024, 0)):
        monkeypatch.setattr(op4_langid, "PIECE", piece)
        monkeypatch.setattr(op4_langid, "TABLE", table)
        for got, text in zip(op4_langid.CrossParser(samples).predict(texts), texts):
            want = brute(samples, text)
            assert got[0] == want[0] and abs(got[1] - want[1]) < 1e-9 and abs(got[2] - want[2]) < 1e-9


def test_phrases_cross_words_and_score_means_something():
    parser = op4_langid.CrossParser({"x": "abc def ghi", "y": "cba fed ihg"})
    assert parser.phrases(["abc def"])[0].tolist() == [[1, 7]]
    short, long, torn = (s for _, s, _ in parser.predict(["ab", "abc def ghi", "abc fed abc fed abc"]))
    assert torn < short < long < 1


def test_samples_are_whole_texts(spark):
    long = "wort " * 30_000
    rows = [(1, long, "de"), (2, "ab cd", "en"), (3, "x" * 60_000, "en"), (4, "ef", "en"), (5, "12", "q")]
    got = op4_langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(got["en"].split("\n")) == ["ab cd", "ef"] and 49_000 < len(got["de"]) <= 50_000 and set(got) == {"de", "en"}


def test_sample_is_as_large_as_stated(spark):
    rows = [(i, "abcd " * 400, "en") for i in range(100)]
    got = op4_langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert op4_langid.SAMPLE_CHARS == 50_000 <= len(got["en"])
