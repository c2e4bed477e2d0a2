"""Model operators with the deterministic models, and the Python batch path."""

from pyspark.sql import functions as F

from reelhouse.operators import categorize as C
from reelhouse.operators import models as M
from reelhouse.operators import vocabulary as V


def _docs(spark):
    long = " ".join(f"Sentence number {i} is here." for i in range(2000))   # ~60k chars
    return spark.createDataFrame([(1, long), (2, "Short one. Second."), (3, ""), (4, None)],
                                 "id bigint, t string")


def test_summary_passes_shorten(spark):
    out = {r.id: r.t for r in M.summarize(_docs(spark), "t", "t", size=200).collect()}
    assert out[2] == "Short one." and out[3] == "" and out[4] is None
    assert len(out[1]) <= 200          # several passes were needed


def test_every_sentence_of_a_text_counts(spark):
    """Changing the last sentence of a text changes its summary and its themes."""
    head = "Some words. " * 900
    df = spark.createDataFrame([(1, head + "End."), (2, head + "The last one is extraordinarily long."), (3, head + "a.")], "id bigint, t string")
    summary = {r.id: r.t for r in M.summarize(df, "t", "t").collect()}
    themes = {r.id: r.t for r in M.themes(df, "t", "t").collect()}
    assert "extraordinarily" in summary[2] and summary[2] != summary[1]
    assert "- extraordinarily" in themes[2] and themes[2] != themes[1]
    assert M.blurb(df, "t", "t").where("id = 1").first().t != summary[1]


def test_a_failing_model_keeps_the_row(spark):
    calls = []

    def fn(instructions, texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("refused")
        return [t.upper() for t in texts]

    df = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, "x" * 5000 + "bad"), (4, None), (5, "")], "id bigint, t string")
    out = M.summarize(df, "t", "t", model=M.BatchModel(fn, 2))
    good, bad = M.split_failures(out, "t")
    assert {r.id: r.t for r in good.collect()} == {1: "OK", 4: None, 5: ""}
    assert {r.id: r.problem for r in bad.collect()} == {2: "RuntimeError: refused", 3: "RuntimeError: refused"}
    assert calls == []


def test_summary_single_pass_when_short_enough(spark):
    df = _docs(spark)
    once = {r.id: r.t for r in M.summarize(df, "t", "t", size=10**9).collect()}
    # one answer per 4096-char chunk of the whole text, joined by newlines
    assert once[1].count("\n") == (len(df.where("id = 1").first().t) - 1) // 4096


def test_batch_model_equals_expression_model(spark):
    df = _docs(spark)
    a = {r.id: r.t for r in M.summarize(df, "t", "t", size=300).collect()}
    b = {r.id: r.t for r in M.summarize(df, "t", "t", size=300, model=M.extract_batch_model(4)).collect()}
    assert a == b


def _lib(spark, cats):
    return spark.createDataFrame([(i, c) for i, c in enumerate(cats)], "id bigint, category string")


def test_categorize_constrained(spark):
    vocab = spark.createDataFrame([("News",), ("Music",), ("Science & Tech",)], "category string")
    items = spark.createDataFrame([(1, "music news music"), (2, "tech news"), (3, "nothing")],
                                  "id bigint, t string")
    out = {r.id: r.category for r in C.categorize(items, "id", F.col("t"), vocab).collect()}
    assert out == {1: "Music", 2: "News", 3: None}


def test_categorize_free_retries(spark):
    # candidates: "News" not stored (invalid), "music" stored as "Music" (valid, ILIKE)
    lib = _lib(spark, ["Music", "Sport"])
    vocab = spark.createDataFrame([("News",), ("music",), ("a b c d",), ("Sport",)], "category string")
    items = spark.createDataFrame([(1, "news news music"), (2, "news"), (3, "a b c d news"),
                                   (4, "zzz"), (5, "sport")], "id bigint, t string")
    out = {r.id: r.category for r in C.categorize_free(items, "id", F.col("t"), vocab, lib).collect()}
    assert out[1] == "music"            # News rejected, retry picks the next candidate
    assert out[2] == "Uncategorized"    # only an invalid candidate, retries run out
    assert out[3] == "Uncategorized"    # a rejected answer of four words
    assert out[4] == "Uncategorized"    # nothing scores
    assert out[5] == "Sport"


def test_membership_wildcards(spark):
    lib = _lib(spark, ["cat_en", "Music"])
    ans = spark.createDataFrame([(1, "CAT_EN"), (2, "cat%"), (3, "mus_c"), (4, "news"), (5, None)],
                                "id bigint, a string")
    out = {r.id: r.known for r in V.membership(ans, "a", lib).collect()}
    assert out == {1: True, 2: True, 3: True, 4: False, 5: False}


def test_membership_patterns(spark):
    lib = _lib(spark, ["cat_en", "Music", "cat_fr", "news_x", "sport", "ACDC", "100%", None])
    ans = {1: "CAT_EN", 2: "cat%", 3: "mus_c", 4: "news", 6: "n_ws_x", 7: "%t", 8: "x_y", 9: "AC\\DC", 10: "sport\\",
           11: "%", 12: "_____", 13: "________", 14: "______%", 15: "_______%", 16: "cat\\_en", 17: "mus\\_c", 18: "100\\%", 19: "1\\%",
           20: "", 21: "a%\\c", 22: "\\\\"}
    df = spark.createDataFrame([*ans.items(), (5, None)], "id bigint, a string")
    got = {r.id for r in V.membership(df, "a", lib).where("known").collect()}
    assert got == {1, 2, 3, 6, 7, 9, 11, 12, 14, 16, 18, 21}


def test_prompts_and_model_categories(spark):
    from reelhouse.operators import categorize_model as CM
    lib = _lib(spark, ["Music", "Sport"])
    vocab = spark.createDataFrame([("Music",), ("Sport",)], "category string")
    items = spark.createDataFrame([(1, "t", "s"), (2, "t2", None)], "id bigint, title string, summary string")
    seen = items.select(CM.prompt(CM.item_text(F.col("title"), F.col("summary")), F.lit("A\nB"), F.array(F.lit("C"))).alias("p")).collect()
    assert seen[0].p == "ITEM\nt\n\nSUMMARY\ns\n\nCATEGORIES\nA\nB\n\nPREVIOUS\nC"
    assert "SUMMARY" not in seen[1].p

    def fn(_i, prompts):
        return ["music" if "PREVIOUS\nRock" in p else "Rock" if "t2" in p else "Category: **SPORT**" for p in prompts]

    item = CM.item_text(F.col("title"), F.col("summary"))
    one = {r.id: r.category for r in CM.categorize_by_model(items, "id", item, vocab, M.BatchModel(fn)).collect()}
    assert one == {1: "Sport", 2: None}
    free = {r.id: r.category for r in CM.categorize_free_by_model(items, "id", item, vocab, lib, M.BatchModel(fn)).collect()}
    assert free == {1: "SPORT", 2: "music"}


def _counting_model(log, memo=None, version="1"):
    """Answers in upper case, refuses "bad", and writes each text it is asked to a file."""
    def fn(instructions, texts):
        if "bad" in texts:
            raise ValueError("refused")
        with open(log, "a") as f:
            f.writelines(f"{t}\n" for t in texts)
        return [t.upper() for t in texts]
    return M.BatchModel(fn, 2, memo, version)


def _asked_so_far(log):
    import os
    return sorted(open(log).read().split()) if os.path.exists(log) else []


def test_memo_asks_once_per_instruction_text_and_version(spark, tmp_path):
    log, memo = str(tmp_path / "log"), str(tmp_path / "memo")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "bad"), (5, "c")], "k int, t string")
    want = [(1, "A", None), (2, "B", None), (3, "A", None), (4, None, "ValueError: refused"), (5, "C", None)]

    def run(df=rows, instruction="do", version="1"):
        return sorted(map(tuple, M.answer_rows(df, "t", instruction, _counting_model(log, memo, version)).collect()))

    assert run() == want and _asked_so_far(log) == ["a", "b", "c"]
    assert run() == want and _asked_so_far(log) == ["a", "b", "c"]  # only the failed one is asked again
    more = spark.createDataFrame([(9, "d"), (8, "a")], "k int, t string")
    assert run(more) == [(8, "A", None), (9, "D", None)] and _asked_so_far(log) == ["a", "b", "c", "d"]
    run(more, instruction="other")
    run(more, version="2")
    assert _asked_so_far(log) == ["a", "a", "a", "b", "c", "d", "d", "d"]
    assert run(more.limit(0)) == []


def test_memo_serves_shortening_and_free_categories(spark, tmp_path):
    from reelhouse.operators import categorize_model as CM
    log, memo = str(tmp_path / "log"), str(tmp_path / "memo")
    docs = spark.createDataFrame([(1, "one two"), (2, "three"), (3, None), (4, "")], "id int, x string")
    for _ in range(2):
        out = M.shorten_loop(docs, "x", 4, "first", "again", _counting_model(log, memo), passes=2)
        assert {r.id: r.x for r in out.collect()} == {1: "ONE TWO", 2: "THREE", 3: None, 4: ""}
    first = _asked_so_far(log)
    assert len(first) == len("one two three ONE TWO THREE".split())  # a text that an earlier pass asked is known
    lib = spark.createDataFrame([("cat",)], "category string")
    items = spark.createDataFrame([(1, "i"), (2, "j")], "id int, title string")
    answers = []
    for _ in range(2):
        got = CM.categorize_free_by_model(items, "id", CM.item_text(F.col("title")), lib, lib, _counting_model(log, memo))
        answers.append(sorted(map(str, got.collect())))
        answers.append(_asked_so_far(log))
    assert answers[0] == answers[2] and answers[1] == answers[3]
