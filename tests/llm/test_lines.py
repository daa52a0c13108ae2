import re

import corpus_pipeline
from lineglass.llm import lines
from tests.llm import helpers as h

PASSAGE = h.prose(99, 70)


def texts():
    clean = [h.prose(s, 120) for s in range(12)]
    holds = [h.prose(50 + s, 60) + " " + PASSAGE + " " + h.prose(80 + s, 60) for s in range(6)]
    return clean, holds


def test_later_copies_of_a_passage_go_and_the_rest_stays(spark):
    clean, holds = texts()
    docs = h.documents(spark, clean + holds)
    rows = {r.doc_id: r for r in lines.without_repeats(docs).collect()}
    for i, text in enumerate(clean):
        assert rows[i].text == text and rows[i].removed_lines == 0
    first = len(clean)
    assert rows[first].text == holds[0]
    for k in range(1, len(holds)):
        left = rows[first + k].text
        assert rows[first + k].removed_lines > 0
        assert len(set(PASSAGE.split()[12:-12]) - set(left.split())) > 0
        assert len(left.split()) <= 120 + 24 + 2
        assert left.startswith(h.prose(50 + k, 60)[:200]) and left.endswith(h.prose(80 + k, 60)[-200:])


def test_lines_put_together_are_the_text(spark):
    odd = [*texts()[1], "no marks " * 80, "A!! B!! C!! " * 60, "a | b | c " * 60, "\n\n\n", "x. \n y, z"]
    docs = h.documents(spark, odd)
    for r in docs.selectExpr("text", f"{lines.lines_sql('text')} AS parts").collect():
        assert "".join(r.parts) == r.text


def test_exact_copies_become_empty_and_short_repeats_stay(spark):
    clean, _ = texts()
    docs = h.documents(spark, [clean[0], clean[0], "Short line.\n" + clean[1], "Short line.\n" + clean[2]])
    got = [r.text for r in lines.without_repeats(docs).orderBy("doc_id").collect()]
    assert got == [clean[0], "", "Short line.\n" + clean[1], "Short line.\n" + clean[2]]


def test_every_deleted_line_stands_in_an_earlier_text(spark):
    clean, holds = texts()
    mixed = [*clean, *holds, clean[3] + "\n" + holds[2], holds[4][:300] + clean[5]]
    rows = lines.without_repeats(h.documents(spark, mixed)).orderBy("doc_id").collect()
    for r in rows:
        kept = re.findall(r"\S+", r.text)
        for word in set(re.findall(r"\S+", mixed[r.doc_id])) - set(kept):
            assert any(word in mixed[d] for d in range(r.doc_id))


def test_plan_is_native(spark):
    plan = lines.without_repeats(h.documents(spark, texts()[1]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_odd_rows(spark):
    got = lines.without_repeats(h.odd(spark))
    assert got.columns == [*h.odd(spark).columns, "removed_lines"]
    rows = got.collect()
    assert len(rows) == 10
    assert [r.text for r in rows if r.doc_id == 1] == [None]
    assert sorted(r.text for r in rows if r.doc_id == 4) == sorted([h.prose(3, 80)] * 2 + [h.prose(4, 80)])
    assert lines.without_repeats(h.odd(spark).limit(0)).collect() == []


def sentence(seed, words):
    return re.sub(r"[.,]", "", h.prose(seed, words)) + "."


def pairs(passages):
    """Two hosts for each passage, the first ones before the second ones."""
    return [h.prose(10_000 * k + n, 40 + k) + ". " + p + " " + h.prose(50_000 * k + n, 40) for k in (1, 2) for n, p in enumerate(passages)]


def words_left(spark, texts):
    rows = lines.without_repeats(h.documents(spark, texts)).orderBy("doc_id").collect()
    return [len(r.text.split()) for r in rows]


def test_passages_of_few_long_sentences_go(spark):
    passages = [" ".join(sentence(7000 + 3 * n + k, 18 + k % 2) for k in range(3)) for n in range(30)]
    texts = pairs(passages)
    left = words_left(spark, texts)
    assert left[:30] == [len(t.split()) for t in texts[:30]]
    assert max(left[30:]) <= 82 + 20


def test_runs_equal_brute_force(spark):
    texts = [*pairs([h.prose(300 + n, 30 + n) for n in range(12)]), h.prose(5, 100), h.prose(5, 100), "a b. " * 40]
    docs = h.documents(spark, texts)
    cut = [r.parts for r in docs.orderBy("doc_id").selectExpr(f"{lines.lines_sql('text')} AS parts").collect()]
    first, want = {}, []
    for d, parts in enumerate(cut):
        bare = [x.strip(" \n\r\t") for x in parts]
        gone = set()
        for a in range(len(bare)):
            for b in range(a, len(bare)):
                if sum(len(x.split(" ")) for x in bare[a : b + 1]) >= lines.MIN_WORDS:
                    if first.setdefault(tuple(bare[a : b + 1]), (d, a)) != (d, a):
                        gone |= set(range(a, b + 1))
        want.append("".join(x for k, x in enumerate(parts) if k not in gone))
    assert [r.text for r in lines.without_repeats(docs).orderBy("doc_id").collect()] == want


def test_passages_are_cut_alike_whatever_stands_around(spark):
    bare = lambda seed, n: re.sub(r"[.,]", "", h.prose(seed, n))
    passages = [f"{bare(400 + n, 27)}, {bare(450 + n, 27)}" for n in range(30)]
    texts = [f"{bare(500 + n, 40)} {p} {bare(550 + n, 40)}." for n, p in enumerate(passages)] + [f"Short: {p} end." for p in passages]
    left = words_left(spark, texts)
    assert left[:30] == [len(t.split()) for t in texts[:30]]
    assert max(left[30:]) <= 2 + 20


def test_no_line_is_long(spark):
    texts = [re.sub(r"[.,]", "", h.prose(9, 500)), "слово " * 300, "7 " * 100, " \n\n  x\n \n" * 50]
    for r in h.documents(spark, texts).selectExpr(f"{lines.lines_sql('text')} AS parts").collect():
        assert max(len(x.split()) for x in r.parts) <= 11


def test_sentences_that_stand_alone_earlier_do_not_hide_a_passage(spark):
    alone = [sentence(8000 + n, 12) for n in range(2)]
    passages = [" ".join([sentence(8100 + 2 * n, 11), alone[0], sentence(8101 + 2 * n, 9), alone[1], sentence(8500 + n, 10)]) for n in range(30)]
    texts = [f"{h.prose(1, 20)}. {alone[0]} {h.prose(2, 20)}", f"{h.prose(3, 20)}. {alone[1]} {h.prose(4, 20)}", *pairs(passages)]
    left = words_left(spark, texts)
    assert left[:32] == [len(t.split()) for t in texts[:32]]
    assert max(left[32:]) <= 82 + 20


def brute_force(spark, texts):
    """Every text without what stands in an earlier run of equal lines with enough words."""
    docs = h.documents(spark, texts)
    first, want = {}, []
    for d, row in enumerate(docs.orderBy("doc_id").selectExpr(f"{lines.lines_sql('text')} AS parts").collect()):
        bare = [x.strip(" \n\r\t") for x in row.parts]
        gone = set()
        for a in range(len(bare)):
            words = 0
            for b in range(a, len(bare)):
                words += len(bare[b].split(" "))
                if words >= lines.MIN_WORDS:
                    if first.setdefault(tuple(bare[a : b + 1]), (d, a)) != (d, a):
                        gone |= set(range(a, b + 1))
        want.append("".join(x for k, x in enumerate(row.parts) if k not in gone))
    return want


def test_every_run_has_a_print(spark):
    """Also runs without an anchor, of fewer lines than a gram, within one text and over its end."""
    blanks = "left" + " " * 40 + "right. "
    few = [" ".join(f"{'bcdfg'[n]}{'xyz'[k % 3]}{k}q" for k in range(10)) + ". " for n in range(5)]
    texts = [*(h.prose(900 + n, 50) for n in range(40)), "word " * 90, "same line. " * 40, "".join(few[:3]), blanks + "a. " + blanks]
    again = [f"{h.prose(7, 3 + n)}. {h.prose(900 + n, 50)} {h.prose(8, n)}" for n in range(40)]
    texts += [*again, "x\u0001y. " + texts[3], "word " * 31, "New. " + "".join(few[:3]) + "end", "b. " + blanks, texts[0]]
    rows = lines.without_repeats(h.documents(spark, texts)).orderBy("doc_id").collect()
    assert [r.text for r in rows] == brute_force(spark, texts)


def test_runs_are_hashed_at_repeated_prints_only(spark):
    clean, holds = texts()
    docs = lines._keyed(h.documents(spark, clean + holds))
    runs = lines.hashed_runs(docs.join(lines.places(docs), ["_doc", "_hash"]))
    assert runs.where(f"doc < {len(clean)}").count() == 0
    repeated = runs.groupBy("g").count().where("count > 1").selectExpr("sum(count)").first()[0]
    assert runs.count() < 3 * repeated
    assert lines.prints(docs).count() < 120 * len(clean + holds) / 3


def test_cuts_with_and_without_marks_are_equal(spark):
    odd = [*texts()[1], "no marks " * 80, "A!! B!! C!! " * 60, "a | b | c " * 60, "\n\n\n", "x. \n y, z", " in.  as  on " * 30, "\nя. Ab\n\n c"]
    cuts = {f: lines._cut("text", f) for f in (lines._at_marks, lines._at_ends)}
    rows = h.documents(spark, odd).selectExpr(*(f"{c} AS c{n}" for n, c in enumerate(cuts.values()))).collect()
    assert all(r.c0 == r.c1 for r in rows)


def test_texts_are_shuffled_once(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = h.documents(spark, texts()[1])
        stage = corpus_pipeline.repeated_lines(spark, docs, "")
        assert stage.columns == docs.columns
        for df in (lines.without_repeats(docs), lines.without_repeats(docs.select("doc_id", "text")), stage):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert len(re.findall(r"ReusedExchange .*text", plan)) == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
