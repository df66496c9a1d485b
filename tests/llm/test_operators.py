"""Each operator against its plain version, with nulls, empty and long texts, ties and empty tables."""

import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wiretide.llm import bpe, common, components, decontaminate, exact_dedup, groups, jaccard, labelled, language_model, line_dedup, quality, sharding, substring_dedup, toxicity
from wiretide.llm.labelled import remainder

import brute

DOCS = "doc_id long, text string"


def table(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema).repartition(3)


def same(got, want):
    assert sorted(map(str, got)) == sorted(map(str, want))


def plain(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def words(seed, n, kinds=60):
    r = random.Random(seed)
    return [f"w{r.randrange(kinds)}" for _ in range(n)]


# -- exact dedup


@pytest.mark.parametrize("limit", [1 << 24, 0])
def test_exact_dedup(spark, limit):
    r = random.Random(1)
    base = ["a" * 300, "a" * 299 + "b", "", "  x", "\tx", "x", "é" * 90, "é" * 89 + "è", None, "ab" * 9000, "ab" * 9000 + "c", " "]
    rows = [(r.choice([None, *range(30)]), r.choice(base)) for _ in range(150)]
    got = exact_dedup.exact_dedup(table(spark, rows).withColumn("keep_id", F.lit("clash")), first=4, broadcast_bytes=limit)
    same(plain(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256"), brute.exact_dedup(rows))


def test_exact_dedup_of_nothing_and_of_copies(spark):
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0
    got = exact_dedup.exact_dedup(table(spark, [(k, "same text") for k in range(500)])).collect()
    assert {(r.keep_id, r.group_size) for r in got} == {(0, 500)} and sum(r.kept for r in got) == 1


# -- line dedup


@pytest.mark.parametrize("limit", [1 << 24, 0])
def test_line_dedup(spark, limit):
    r = random.Random(2)
    lines = ["menu", " menu ", "© all", "", "  ", "own"]
    rows = [(k, r.choice(["a", "b", None]), None if k % 17 == 0 else "\n".join(r.choice(lines) if r.random() < 0.4 else f"text {r.random()}" for _ in range(6))) for k in range(120)]
    docs = table(spark, rows, "doc_id long, source string, text string").withColumn("n_lines", F.lit("clash"))
    got = line_dedup.line_dedup(docs, max_ratio=0.3, min_pages=5, broadcast_bytes=limit)
    same(plain(got, "doc_id", "n_lines", "n_dropped", "text"), brute.line_dedup(rows, 0.3, 5))
    assert got.columns == ["doc_id", "source", "text", "n_lines", "n_dropped"]


def test_line_dedup_keeps_small_hosts_and_nothing(spark):
    schema = "doc_id long, source string, text string"
    assert line_dedup.line_dedup(table(spark, [(1, "one", "a\nb")], schema)).first().n_dropped == 0
    assert line_dedup.line_dedup(table(spark, [], schema)).count() == 0


def test_line_dedup_stage_keeps_clashing_columns(spark):
    rows = [(k % 9, "s", f"menu\nown {k}") for k in range(20)] + [(None, None, "menu\nx"), (1, "s", None), (1, "s", "line " * 50_000)]
    docs = table(spark, rows, "doc_id long, source string, text string").withColumns({c: F.lit(c) for c in ("n_lines", "n_dropped", "host", "bad", "__host", "__bad", "pages")})
    got = line_dedup.stage(spark, docs, "")
    assert got.columns == docs.columns and {r.n_lines for r in got.collect()} == {"n_lines"}
    same(plain(got, "doc_id", "text"), [(i, t) for i, _, _, t in brute.line_dedup(rows, line_dedup.MAX_RATIO, line_dedup.MIN_PAGES)])
    assert line_dedup.line_dedup(docs).filter("n_dropped = 1").count() == 20


def test_line_dedup_runs_no_python(spark):
    docs = table(spark, [(1, "s", "a")], "doc_id long, source string, text string")
    plan = line_dedup.line_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# -- byte-pair encoding

ODD = list("abcXYZ  \n\n\t\r\x0b\x0c\x1c\x1f\x85\xa0 　'''s'tré1²½٣!?#$%^&*<|>漢字🙂́‍") + ["<|endoftext|>", "'ll", "'ve", "   ", "zq", "éç", "à la"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary())


def test_encoding_is_that_of_the_library(tokenizer):
    own, r = bpe.load(bpe.vocabulary()), random.Random(3)
    texts = ["".join(r.choice(ODD) for _ in range(r.randrange(30))) for _ in range(20_000)] + ["", " ", "a" * 3000 + "zq" * 2000, "\n" * 500 + "x"]
    texts += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(32, 1200), r.randrange(0x2000, 0x3100)])) for _ in range(12)) for _ in range(20_000)]
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        for text, ids, want in zip(part, own.encode_batch([x.encode() for x in part]), tokenizer.encode_batch(part, add_special_tokens=False)):
            assert np.frombuffer(ids, "<u4").tolist() == want.ids, repr(text)
            assert own.decode_bytes(ids).decode() == tokenizer.decode(want.ids, skip_special_tokens=False)


def test_cuts_are_where_no_token_has_the_pair():
    own = bpe.load(bpe.vocabulary())
    pairs = {(a, b) for token in own.table for a, b in zip(token, token[1:])}
    for text in ("a b c  d à e", "zqxj漢字zq", "don't! !'s #x=1,2;ok", "一 二\u3000三"):
        parts = own.fragments(text.encode())
        assert b"".join(parts) == text.encode() and all((a[-1], b[0]) not in pairs for a, b in zip(parts, parts[1:]))
    assert own.fragments("zqxj".encode()) != [b"zqxj"] and own.fragments("unit zq2 text".encode())[0] == b"unit"


def test_encode_and_decode_tables(spark, tokenizer):
    rows = [(1, "hello world"), (1, "hello world"), (None, None), (3, ""), (4, "long " * 30000)]
    encoded = bpe.encode(table(spark, rows).withColumn("ids", F.lit(1)))
    back = bpe.decode(encoded)
    same(plain(back, "doc_id", "text"), [(i, t or "") for i, t in rows])
    by = {(r.doc_id, r.n_tokens) for r in encoded.collect()}
    assert by == {(i, len(tokenizer.encode(t or "").ids)) for i, t in rows}
    assert bpe.encode(table(spark, [])).count() == 0


def test_memory_of_fragments_is_bounded():
    own = bpe.ByteBPE(bpe.vocabulary(), memo=10)
    for k in range(100):
        own.encode_batch([f"word{k} and x{k}".encode(), b"y" * 200])
        assert len(own.memo) <= 10


# -- language model


def test_language_model(spark, tmp_path):
    rows = [(k, " ".join(words(k, 40))) for k in range(80)] + [(None, "W1 w2"), (90, None), (91, ""), (91, ""), (92, "new\x85word w1 " * 500)]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = language_model.query(spark, str(tmp_path)).collect()
    want = brute.lm(rows)
    key = lambda r: (str(r[0]), r[2])
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9)
    held = [r for r in got if r.held_out and r.n_tokens > 5 and r.n_known == r.n_tokens]
    assert held and all(r.score < 0 for r in got)


@pytest.mark.parametrize("order", [2, 4])
def test_language_model_scores_as_exact_counts_do(spark, order):
    rows = [(k, " ".join(words(k % 70, 40, 25))) for k in range(120)] + [(None, "W1 w2"), (200, None), (201, ""), (201, "")]
    learnt = F.col("doc_id") % 10 != 0
    docs = table(spark, rows).withColumns({"id": F.lit(1), "learnt": F.lit("x"), "number": F.lit(2)})
    got = [(r.doc_id, r.n_tokens, r.score) for r in language_model.score(docs, learnt, order=order, room=1 << 12).collect()]
    want = brute.lm_scores(rows, lambda i: i is not None and i % 10 != 0, order)
    key = lambda r: (str(r[0]), r[1], r[2])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], rel=1e-6)


def test_layouts_grow_with_the_root_of_the_input():
    each, bits = groups.layout(1000)
    assert (each, bits) == (4 << 20, 8)
    sent = {}
    for total in (30e9, 1e12, 1e14):
        each, bits = groups.layout(int(total))
        assert total / each <= 2**bits < 4 * total / each
        sent[total] = total / each * 2**bits / total  # rows for each byte
    assert each < 300 << 20 and max(sent.values()) < 4 * min(sent.values())


@pytest.mark.parametrize("cached", [False, True])
def test_scores_follow_from_the_texts_alone(spark, tmp_path, cached):
    rows = [(k, " ".join(words(k % 50, 80))) for k in range(150)]
    for codec in ("none", "zstd"):
        table(spark, rows).write.option("compression", codec).parquet(f"{tmp_path}/{codec}")
    ask = lambda df: {r.doc_id: r.score for r in language_model.score(df, F.col("doc_id") % 5 > 0).collect()}
    want = ask(spark.read.parquet(f"{tmp_path}/none"))
    other = spark.read.parquet(f"{tmp_path}/zstd")
    got = ask(other.cache() if cached else other)
    assert got == pytest.approx(want, abs=1e-9)
    other.unpersist()


def test_texts_that_occur_twice_score_higher(spark):
    rows = [(k, " ".join(words(k if k < 100 else k - 20, 60, 400))) for k in range(120)]
    got = {r.doc_id: r.score / r.n_tokens for r in language_model.score(table(spark, rows), F.lit(True)).collect()}
    assert min(got[k] for k in range(80, 120)) > max(got[k] for k in range(80))


def test_log_filter_counts_never_fall_short():
    low, counts = np.arange(3000, dtype=np.uint32) * 7, 1 + np.arange(3000) % 50
    levels = language_model.probe(language_model.filled(low, counts), low)
    want = language_model.level_of(counts)
    assert (levels >= want).all() and (levels == want).mean() > 0.98
    other = language_model.probe(language_model.filled(low, counts), low + np.uint32(1))
    assert (other == 0).mean() > 0.98 and language_model.filled(low[:0], counts[:0]).sum() == 0
    values = language_model.level_values()
    assert values[1:4].tolist() == [1, 2, 3] and 90 < values[language_model.level_of(np.array([100]))[0]] < 140


def test_language_model_of_nothing(spark):
    assert language_model.score(table(spark, []), F.lit(True)).count() == 0
    alone = language_model.score(table(spark, [(1, "a b"), (2, None)]), F.lit(False)).collect()
    assert {(r.doc_id, r.train_tokens, r.n_known) for r in alone} == {(1, 0, 0), (2, 0, 0)} and all(r.held_out for r in alone)


# -- decontamination


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_decontamination(spark, block):
    items = [(k, " ".join(words(1000 + k, 14, 500))) for k in range(12)] + [(20, "Short item, ok"), (21, ""), (22, None), (23, "...")]
    r = random.Random(4)
    rows = []
    for k in range(60):
        text = words(k, 30, 500)
        if k % 3 == 0:
            text[10:10] = items[k % 12][1].upper().split()[r.randrange(4) :]
        if k % 5 == 0:
            text += ["SHORT-item", "OK"]
        rows.append((k, ", ".join(text)))
    rows += [(100, None), (101, ""), (102, "é" * 10)]
    got = decontaminate.hits(table(spark, rows), table(spark, items, "item_id long, text string"), block_bytes=block)
    same([(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got.collect()], brute.leaks(rows, items))
    texts = dict(rows)
    for r in got.collect():
        data = (texts[r.doc_id] or "").encode()
        assert sum(len(brute.WORD.findall(data[s.start : s.stop].lower().decode())) for s in r.spans) == r.n_hit


@pytest.mark.parametrize("block", [1 << 20, 100])
def test_decontamination_keeps_rows_of_one_id(spark, block):
    items = [(k, " ".join(words(1000 + k, 12, 500))) for k in range(4)]
    rows = [(7, f"{items[0][1]} x y"), (7, f"x y {items[1][1]}"), (7, f"x y {items[1][1]}"), (None, items[2][1]), (None, items[3][1]), (None, " ".join("abcdefghijkl"))]
    got = decontaminate.hits(table(spark, rows), table(spark, items, "item_id long, text string"), block_bytes=block)
    want = [(7, 14, 12, ["0"]), (7, 14, 12, ["1"]), (7, 14, 12, ["1"]), (None, 12, 12, ["2"]), (None, 12, 12, ["3"]), (None, 12, 0, [])]
    same([(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got.collect()], want)


def test_clean_cuts_only_hits(spark):
    item = "one two three four five six seven eight nine ten"
    docs = table(spark, [(1, f"Before, {item.title()}; after"), (2, "harmless"), (3, None)])
    bench = table(spark, [(7, item)], "item_id long, text string")
    assert {r.doc_id: r.text for r in decontaminate.clean(docs, bench).collect()} == {1: "Before, ; after", 2: "harmless", 3: None}
    none = table(spark, [], "item_id long, text string")
    assert decontaminate.hits(docs, none).filter("n_hit > 0").count() == 0
    assert decontaminate.hits(table(spark, []), bench).count() == 0


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_clean_judges_the_input_alone(spark, block):
    items = [(k, " ".join(words(1000 + k, 30, 500))) for k in range(8)]
    rows = [(k % 5 if k % 7 else None, ", ".join(words(k, 20, 500) + items[k % 8][1].split()[k % 9 :][: 8 + k % 9] + items[(k + 1) % 8][1].split()[5:25])) for k in range(40)] + [(1, None), (2, "")]
    # Cutting the inner window brings the halves of an outer one together, which the input doesn't have.
    outer, inner = items[0][1].split(), items[1][1].split()[:12]
    rows.append((50, " ".join(outer[:6] + inner + outer[6:12])))
    docs = table(spark, rows).withColumns({decontaminate.ROW + "!": F.lit(1), "spans": F.lit("x"), "words": F.lit(2)})
    got = decontaminate.clean(docs, table(spark, items, "item_id long, text string"), block_bytes=block)
    assert got.columns == docs.columns
    whole = {(i, t): n - h for (i, t), (_, n, h, _) in zip(rows, brute.leaks(rows, items))}
    left = sorted(len(brute.WORD.findall((r.text or "").lower())) for r in got.collect())
    assert left == sorted(whole[i, t] for i, t in rows) and whole[rows[-1]] == 12
    long = [(1, " ".join(words(5, 60_000, 500)) + " " + items[3][1])]
    one = decontaminate.hits(table(spark, long), table(spark, items, "item_id long, text string"), block_bytes=block).collect()
    assert [(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in one] == brute.leaks(long, items)


def test_anchors_find_every_window():
    r = random.Random(13)
    for window in (2, 3, 7, 10):
        items = [(k, " ".join(words(k, r.randrange(30), 4)).encode()) for k in range(6)]
        machine = decontaminate.automaton(items, window)
        for seed in range(60):
            text = " ".join(words(100 + seed, r.randrange(60), 4))
            n, mask, found = decontaminate.scan(machine, text.encode(), window)
            (_, want_n, want_hit, want) = brute.leaks([(0, text)], [(k, t.decode()) for k, t in items], window)[0]
            assert (n, int(mask.sum()), sorted(map(str, found))) == (want_n, want_hit, want)


def test_templated_items_have_rare_anchors():
    opening = "which of the following is true of"
    items = [(k, f"{opening} {' '.join(words(k, 14, 5000))}".encode()) for k in range(3000)]
    machine = decontaminate.automaton(items)
    assert max(len(places) for _, (_, places) in machine[0].items()) < 20
    text = f"{opening} this ".encode() * 40
    assert decontaminate.scan(machine, text)[1:] == (pytest.approx(np.zeros(0)), set()) or not decontaminate.scan(machine, text)[2]
    _, mask, found = decontaminate.scan(machine, text + items[7][1])
    assert found == {7} and mask.sum() == 21
    for _, text in items[:50]:  # each window still holds an anchor
        own = decontaminate.anchor_places([(0, text)])[0]
        assert all(any(w <= p <= w + 5 for p in own) for w in range(21 - 9))


@pytest.mark.parametrize("block", [1 << 20, 100])
def test_items_without_id_are_hits(spark, block):
    items = [(None, " ".join(words(k, 12, 500))) for k in range(3)] + [(4, " ".join(words(4, 12, 500)))]
    docs = table(spark, [(1, f"Before, {items[0][1]}; after"), (2, f"{items[1][1]} and {items[3][1]}"), (3, "harmless")])
    bench = table(spark, items, "item_id long, text string")
    got = decontaminate.hits(docs, bench, block_bytes=block).collect()
    same([(r.doc_id, r.n_hit, list(r["items"])) for r in got], [(1, 12, []), (2, 24, ["4"]), (3, 0, [])])
    assert {r.doc_id: r.text for r in decontaminate.clean(docs, bench).collect()} == {1: "Before, ; after", 2: " and ", 3: "harmless"}


# -- near duplicates


def near_rows():
    r, rows = random.Random(5), []
    for _ in range(60):
        base = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(1, 3))) for _ in range(r.choice([3, 5, 6, 8, 10, 12, 15, 17, 20, 25, 40, 80]))]
        for _ in range(r.randrange(1, 6)):
            w = list(base)
            for _ in range(r.randrange(max(1, len(w) // 12) + 1)):
                if r.random() < 0.5 and len(w) > 1:
                    del w[r.randrange(len(w))]
                else:
                    w.insert(r.randrange(len(w) + 1), r.choice(["zz", "qq", "a"]))
            rows.append((len(rows), " ".join(w)))
    return rows + [(len(rows) + k, t) for k, t in enumerate(["", None, " \n", "A b", "a B", "x\x85y z"])]


@pytest.mark.parametrize(("k", "percent", "light"), [(4, 85, None), (4, 85, 1), (4, 85, 16), (5, 80, None)])
def test_jaccard_join(spark, k, percent, light):
    rows = near_rows()
    got = jaccard.jaccard_join(table(spark, rows).withColumns({"n": F.lit("x"), "id": F.lit(1), "class": F.lit(2)}), k=k, percent=percent, light=light)
    same(plain(got, "doc_id", "n_shingles", "component_id"), brute.jaccard(rows, k, percent))


def test_jaccard_join_of_many_near_copies_by_few_hubs(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PART", 8)
    r, base, rows = random.Random(11), words(1, 60, 5000), []
    for _ in range(200):
        w = list(base)
        for _ in range(r.randrange(4)):
            w[r.randrange(60)] = f"x{r.randrange(3)}"
        rows.append((len(rows), " ".join(w)))
    rows += [(200, "only one word" * 5), (201, " ".join(words(2, 30_000, 900))), (202, " ".join(words(2, 30_000, 900)) + " end")]
    for percent in (80, 85, 90):
        got = jaccard.jaccard_join(table(spark, rows), percent=percent)
        same(plain(got, "doc_id", "n_shingles", "component_id"), brute.jaccard(rows, 4, percent))


def test_jaccard_join_of_nothing_and_ties(spark):
    assert jaccard.jaccard_join(table(spark, [])).count() == 0
    assert jaccard.jaccard_join(table(spark, [(1, None), (2, "")])).filter("component_id = doc_id AND n_shingles = 0").count() == 2
    ties = jaccard.jaccard_join(table(spark, [(None, "a b c d e"), (None, "a b c d e"), (2, "a b c d e"), (2, "other words are here now")]))
    same(plain(ties, "doc_id", "component_id"), [(None, 2), (None, 2), (2, 2), (2, 2)])


def test_jaccard_stage_keeps_one_row_of_a_group(spark):
    copy, other = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(3, copy), (1, copy), (1, copy), (None, copy), (None, other), (None, other), (1, other + " x y z a b c"), (5, None), (6, ""), (5, None)]
    got = jaccard.stage(spark, table(spark, rows).withColumn("r", F.lit(1)).withColumn("row", F.lit(2)), "")
    assert got.columns == ["doc_id", "text", "r", "row"]
    same(plain(got, "doc_id", "text"), [(1, copy), (None, other), (1, other + " x y z a b c"), (5, None), (5, None), (6, "")])


def test_parts_find_the_components_of_their_links(monkeypatch):
    monkeypatch.setattr(jaccard, "COLUMNS", 50)
    r = random.Random(12)
    for percent in (60, 85):
        sets = []
        for _ in range(150):
            base = set(range(r.choice([0, 8, 100]), r.choice([110, 112, 120])))
            sets.append(np.array(sorted(base - set(r.sample(range(120), r.randrange(25)))), np.uint64))
        found = jaccard.linked(np.arange(150), sets, np.arange(150), percent)
        want = brute.jaccard([(k, " ".join(map(str, s))) for k, s in enumerate(sets)], 1, percent)
        root = list(range(150))
        for a, b in found:
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = [new if x == old else x for x in root]
        assert [(k, root[k]) for k in range(150)] == [(i, c) for i, _, c in want] and len({a for a, _ in found}) == len(found)
    same_root = jaccard.linked(np.arange(3), [np.array([k], np.uint64) for k in range(3)], np.array([5, 6, 5]), 85)
    assert same_root == [(2, 0)]


def test_boundary_follows_cost():
    assert jaccard.boundary(1, 85) <= jaccard.boundary(20, 85) <= jaccard.boundary(500, 85)
    assert jaccard.subsets(7, 85) == 8 and jaccard.need(20, 85) == 17 and jaccard.boundary(1e6, 85) > 40


def test_components_of_long_paths(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (101, 102), (200, 200)]
    random.Random(6).shuffle(edges)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- sharding


@pytest.mark.parametrize("n", [0, 1, 5, 8, 203])
def test_sharding(spark, n):
    r = random.Random(7)
    rows = [(k if k % 9 else None, None if k % 13 == 0 else "x" * (k % 5) + "é", r.choice(["big", "big", "big", "b", "c", None])) for k in range(n)]
    out = sharding.interleave(table(spark, rows, "doc_id long, text string, source string"), 8).collect()
    assert len(out) == n
    same([(r.doc_id, r.size, r.text_crc32) for r in out], [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows])
    by = [sorted(r.slot for r in out if r.shard == s) for s in range(8)]
    assert all(slots == list(range(len(slots))) for slots in by) and max(map(len, by)) - min(map(len, by)) <= 1
    for source in {s for _, _, s in rows}:
        counts = [sum(r.source == source and r.shard == s for r in out) for s in range(8)]
        assert max(counts) - min(counts) <= 2


def plain_shards(rows, shards, seed=sharding.SEED):
    """(id, stratum, size, crc, shard, slot) by sorting in one list."""
    import hashlib

    number = lambda text: int(hashlib.md5(text.encode()).hexdigest()[:15], 16)
    strata = {}
    for i, of, text in rows:
        data = (text or "").encode()
        size, crc = len(data) + 1, zlib.crc32(data)
        strata.setdefault(of, []).append((number(f"{seed}:{'' if i is None else i}:{size}:{crc}"), (i is not None, i or 0), crc, size, i))
    order = []
    for of, held in strata.items():
        offset = number(f"{seed}:{'none' if of is None else '=' + of}") / (1 << 60)
        for rank, (key, by, crc, size, i) in enumerate(sorted(held)):
            order.append(((rank + offset) / len(held), key, by, crc, size, of or "", i, of))
    out, n = [], len(rows)
    for k, (*_, crc, size, _, i, of) in enumerate(sorted(order, key=lambda r: r[:6])):
        shard = k * shards // n
        out.append((i, of, size, crc, shard, k - (shard * n + shards - 1) // shards))
    return out


@pytest.mark.parametrize("kind", ["few", "many"])
def test_shards_are_those_of_one_sorted_list(spark, kind):
    r = random.Random(9)
    strata = ["a", "b", None, ""] if kind == "few" else [f"host{k}" for k in range(400)]
    rows = [(r.choice([None, *range(300)]), r.choice(strata), r.choice([None, "", "é", "x" * r.randrange(50)])) for _ in range(500)]
    docs = table(spark, rows, "doc_id long, source string, text string")
    got = sharding.interleave(docs, 8)
    want = plain_shards(rows, 8)
    same(plain(got, "doc_id", "source", "size", "text_crc32", "shard", "slot"), want)
    if kind == "many":
        # Names don't decide: each shard has hosts of all parts of the alphabet.
        firsts = [{of[4] for _, of, *_, shard, _ in want if shard == s} for s in range(8)]
        assert min(map(len, firsts)) >= 6


def test_sharding_is_repeatable(spark):
    rows = [(k, str(k), f"s{k % 3}") for k in range(100)]
    place = lambda parts: sorted(map(tuple, sharding.interleave(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts), 8).collect()))
    assert place(2) == place(7)


def test_sharding_spreads_rows_of_one_id(spark):
    rows = [(None if k % 2 else 5, f"text {k}", "s") for k in range(400)] + [(5, "long " * 40_000, None)]
    docs = table(spark, rows, "doc_id long, text string, source string").withColumns({"shard": F.lit("x"), "size": F.lit("y"), "__key": F.lit(1)})
    out = sharding.interleave(docs, 8).collect()
    assert sorted(r.size for r in out) == sorted(len(t) + 1 for _, t, _ in rows)
    by = [sorted(r.slot for r in out if r.shard == s) for s in range(8)]
    assert all(slots == list(range(len(slots))) for slots in by) and {len(x) for x in by} == {50, 51}


# -- substring dedup


@pytest.mark.parametrize("most", [2_000, 3, 0])
def test_substring_dedup(spark, most):
    r = random.Random(8)
    passages = [words(2000 + k, r.randrange(30, 60), 400) for k in range(12)]
    rows = []
    for k in range(100):
        w = []
        for _ in range(r.randrange(6)):
            w += words(3000 + 10 * k, r.randrange(40), 400)
            w += r.choice(passages) if r.random() < 0.6 else []
            w += ["a"] * r.randrange(20, 80) if r.random() < 0.1 else []
            w += ["a", "b"] * r.randrange(10, 40) if r.random() < 0.1 else []
        rows.append((r.choice([None, k, k, 3]), " ".join(w)))
    rows += [(500, None), (501, ""), (502, " \n "), (503, " ".join(passages[0])), (503, " ".join(passages[0]))]
    got = substring_dedup.substring_dedup(table(spark, rows).withColumn("kept", F.lit(1)), most=most)
    same(plain(got, "doc_id", "n_words", "n_removed", "kept_sha256"), brute.substrings(rows))


def test_substring_dedup_of_nothing_and_with_a_full_filter(spark):
    assert substring_dedup.substring_dedup(table(spark, [])).count() == 0
    rows = [(k, " ".join(words(k % 7, 50, 900))) for k in range(20)] + [(30, "long " + " ".join(words(30, 60_000, 900))), (31, "w " * 20_000)]
    got = substring_dedup.substring_dedup(table(spark, rows), filter_bits=1 << 14)
    same(plain(got, "doc_id", "n_words", "n_removed", "kept_sha256"), brute.substrings(rows))


def test_a_hot_line_leaves_no_large_group(spark, tmp_path):
    line = words(1, 20, 10_000)
    rows = [(k, " ".join(words(10 + k, 40, 10_000) + line + words(5000 + k, 40, 10_000))) for k in range(400)]
    docs = table(spark, rows)
    _, hot = substring_dedup.filters(docs, "text", 35, 8, 50, 1 << 22)
    assert hot[0].array.any() and not hot[-1].array.any()
    got = substring_dedup.substring_dedup(docs, most=50)
    assert got.filter("n_removed > 0").count() == 0


def test_hashes_of_ranges_tell_words_apart():
    docs = [[b"a", b"b", b"c", b"a", b"b", b"d"], [f"x{k}".encode() for k in range(500)]]
    s = substring_dedup.Suffixes(docs, 35, 8)
    got = s.range_hash(np.array([0, 3, 1, 0, 3]), np.array([2, 5, 3, 3, 6]))
    assert got[0] == got[1] and len(set(got.tolist())) == 4
    a = np.arange(6, 490)
    assert len(set(s.range_hash(a, a + 3).tolist())) == len(a)


def test_deepest_nodes_of_subtrees():
    bodies = [b"a b c d e x", b"a b c d e y", b"b c d q", b"z"]
    ids, starts, _ = common.intern_words([x.split() for x in bodies])
    assert substring_dedup.node_depths(ids, starts, np.array([0, 6, 1, 12, 16])).tolist() == [5, 5, 3, 3, 0]
    assert substring_dedup.repeats(bodies, np.array([2, 2, 1, 1]), np.array([1, 1, 1, 2]), 4) == [[(0, 5)], [(0, 5)], [], []]
    assert substring_dedup.lengths(35, 8) == [8, 12, 18, 27, 35]


# -- classifiers


def test_quality_learns_and_reads_as_tables(spark):
    rows, labels = [], []
    for k in range(400):
        good = k % 3 > 0
        rows.append((k, " ".join(w if good else w.upper() + "!!" for w in words(k, 30))))
        labels.append((k, int(good), 0))
    docs, marks = table(spark, rows), table(spark, labels, "doc_id long, quality int, toxic int")
    model = quality.train(docs, marks, "quality", remainder(F.col("doc_id"), 5) != 0)
    out = quality.score(docs, model).join(marks, "doc_id").filter(remainder(F.col("doc_id"), 5) == 0)
    assert out.filter((F.col("score") >= 0.3) != (F.col("quality") == 1)).count() == 0
    again = quality.train(docs.repartition(7), marks, "quality", remainder(F.col("doc_id"), 5) != 0)
    assert np.allclose(again.tables, model.tables)
    odd = quality.score(table(spark, [(None, None), (1, ""), (1, "x" * 200_000)]), model).collect()
    assert len(odd) == 3 and all(0 <= r.score <= 1 for r in odd)


def test_samples_are_bounded_and_columns_may_clash(spark):
    rows = [(1 if k % 2 else k, f"text {k}") for k in range(300)] + [(None, "x"), (2, None)]
    docs = table(spark, rows).withColumns({c: F.lit(7) for c in ("y", "id", "__id", "label", "quality", "score", "x")})
    marks = table(spark, [(k, k % 3 % 2, int(k % 5 == 0)) for k in range(300)] + [(None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    assert labelled.sample(docs, marks.filter("doc_id = 1"), "quality", F.lit(True), rows=10).count() == 10
    assert labelled.sample(docs, marks, "quality", F.lit(True), rows=20).count() <= 20
    for got in (quality.score(docs, quality.train(docs, marks, "quality", F.lit(True))), toxicity.score(docs, toxicity.train(docs, marks, F.lit(True)))):
        assert got.columns == ["doc_id", "score"] and got.count() == len(rows)


def test_toxicity_stage_keeps_clashing_columns(spark, tmp_path):
    rows = [(k, "plain words here") for k in range(40)] + [(None, None), (3, ""), (3, "idiot scum moron idiot")]
    docs = table(spark, rows).withColumns({"score": F.lit("mine"), "y": F.lit(1)})
    table(spark, [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.stage(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and {r.score for r in got.collect()} == {"mine"}
    same(plain(got, "doc_id", "text"), rows[:-1])


def test_quality_without_labels(spark):
    docs = table(spark, [(1, "a"), (2, None)])
    for marks in ([], [(1, 1, 0)], [(1, None, None)]):
        model = quality.train(docs, table(spark, marks, "doc_id long, quality int, toxic int"), "quality", F.lit(True))
        assert all(0 < r.score < 1 for r in quality.score(docs, model).collect())
    assert quality.score(table(spark, []), quality.fit(np.zeros((0, 3)), np.zeros(0))).count() == 0


def test_pairs_add_what_single_features_cannot():
    r = np.random.RandomState(0)
    x = r.rand(3000, 3)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert ((model.score(x) > 0.5) == (y > 0.5)).mean() > 0.9 and (0, 1) in model.pairs


def test_trees_on_pairs_cut_where_the_gain_is():
    g, h = np.ones((4, 5)), np.ones((4, 5))
    g[:1, 3:] = g[1:, :2] = -1
    step = quality._pair_tree(g, h)
    assert len(np.unique(step)) == 4 and (np.sign(step[0]) == [1, 1, 1, -1, -1]).all() and (np.sign(step[3]) == [-1, -1, 1, 1, 1]).all()
    assert (quality._pair_tree(g.T, h.T) == step.T).all() and not quality._pair_tree(g * 0, h).any()


@pytest.fixture(scope="module")
def toxic_tables(spark):
    rows, labels = [], []
    r = random.Random(9)
    for k in range(900):
        w, bad = words(k, 40, 300), k % 6 == 0
        if bad:
            for _ in range(2):
                w.insert(r.randrange(40), r.choice(["Idiot,", "scum", "moron!"]) if k % 12 else f"xqblar{r.choice('abcdef')}")
        rows.append((k, " ".join(w)))
        labels.append((k, 1, int(bad)))
    return table(spark, rows), table(spark, labels, "doc_id long, quality int, toxic int")


def test_toxicity_finds_known_and_learnt_words(toxic_tables):
    docs, marks = toxic_tables
    model = toxicity.train(docs, marks, remainder(F.col("doc_id"), 3) != 1)
    assert any("xqbla" in v for v in model.voters)
    out = toxicity.score(docs, model).join(marks, "doc_id").filter(remainder(F.col("doc_id"), 3) == 1)
    n = out.agg(F.expr("count_if(score >= 0.7 AND toxic = 1)"), F.expr("count_if(score >= 0.7 AND toxic = 0)"), F.sum("toxic")).first()
    assert n[0] >= 0.95 * n[2] and n[1] == 0


def test_label_model_knows_copies_of_a_voter():
    r = np.random.RandomState(1)
    y = r.rand(3000) < 0.2
    votes = np.stack([np.where(y, r.rand(3000) < 0.5, r.rand(3000) < 0.02) for _ in range(4)], axis=1)
    votes = np.hstack([votes, votes[:, :1], votes[:, :1]])
    parent = toxicity.dependences(votes.astype(float), y.astype(float))
    copies = {0, 4, 5}
    assert sum(p in copies and k in copies for k, p in enumerate(parent.tolist())) == 2
    q = toxicity.posterior(votes, 0.2)
    assert ((q > 0.5) == y).mean() > 0.9


def test_label_model_equals_its_plain_version():
    r = np.random.RandomState(4)
    for n, m, share in ((200, 5, 0.2), (60, 1, 0.5), (3, 4, 0.1)):
        y = r.rand(n) < share
        votes = np.stack([np.where(y, r.rand(n) < 0.6, r.rand(n) < 0.1) for _ in range(m)], axis=1)
        votes[:, -1] |= votes[:, 0]
        for rounds in (1, 7):
            want = brute.label_model(votes.tolist(), share, rounds, toxicity.SILENT, toxicity.SPOKEN, lambda q: toxicity.dependences(votes.astype(float), np.array(q)).tolist())
            assert np.allclose(toxicity.posterior(votes, share, rounds), want, atol=1e-9)


def test_voters_of_one_language_keep_their_rows():
    # Ten words of one language, some in each of its toxic rows, and two of each of three others: what fires is toxic.
    r = np.random.RandomState(5)
    kind = r.choice(3, 12000, p=[0.896, 0.063, 0.041])
    votes = np.zeros((12000, 16), np.bool_)
    for row in np.flatnonzero(kind == 1):
        votes[row, r.choice(10, 1 if r.rand() < 0.25 else r.randint(2, 11), replace=False)] = True
    tongue = r.randint(3, size=12000)
    for row in np.flatnonzero(kind == 2):
        votes[row, 10 + tongue[row]] = True
        votes[row, 13 + tongue[row]] = r.rand() < 0.5
    caught = [(toxicity.posterior(votes, 0.104, one_sided=x) >= toxicity.THRESHOLD)[kind > 0].mean() for x in (False, True)]
    assert caught[0] < 0.9 and caught[1] == 1


def test_toxicity_odd_rows(spark, toxic_tables):
    docs, marks = toxic_tables
    odd = table(spark, [(None, None), (1, ""), (1, "moron " * 50_000)])
    model = toxicity.train(docs, marks.limit(0), F.lit(True))
    got = toxicity.score(odd.withColumn("score", F.lit("clash")), model, keep=True)
    assert got.columns == ["doc_id", "text", "score"] and all(0 <= r.score <= 1 for r in got.collect())
    assert toxicity.score(odd.limit(0), model).count() == 0


# -- shared parts


def test_segments_cut_sorted_keys():
    keys = np.sort(common.mix64(np.arange(1000, dtype=np.uint64)))
    ends = common.cut_segments(keys, 4)
    assert ends[0] == 0 and ends[-1] == 1000 and all((keys[a:b] >> np.uint64(60) == s).all() for s, (a, b) in enumerate(zip(ends, ends[1:])))


def test_filter_has_no_false_misses():
    keys = common.mix64(np.arange(2000, dtype=np.uint64))
    rows = []
    for s in range(4):
        own = keys[keys >> np.uint64(62) == s]
        rows.append((s, common.SegmentFilter.build(common.low_bits(own, 2), 1 << 12)))
    found = common.SegmentFilter(rows, 2, 1 << 14)
    assert found.has(keys).all() and found.has(common.mix64(np.arange(9000, 10000, dtype=np.uint64))).mean() < 0.2


def test_ngrams_stay_in_their_document():
    ids, starts, seen = common.intern_words([[b"a", b"b"], [], [b"c"], [b"a", b"b", b"c"]])
    grams, at = common.ngram_hashes(common.word_hashes(seen)[ids], starts, 2)
    assert at.tolist() == [0, 3, 4] and grams[0] == grams[1] != grams[2]


# -- pipeline


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_pipeline(spark, tokenizer):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, before = [], docs
    for name, stage in P.STAGES[:-1]:
        after = common.materialize(stage(spark, before, sf), name)
        assert after.columns == docs.columns
        names.append(name)
        rows = [(r.doc_id, r.source, r.text) for r in before.collect()]
        if name == "toxicity":
            toxic = {r.doc_id for r in toxicity.query(spark, sf).filter("predicted = 1").collect()}
            same(plain(after, "doc_id", "text"), [(i, t) for i, _, t in rows if i not in toxic])
            assert 0 < len(toxic) < len(rows)
        if name == "line_dedup":
            same(plain(after, "doc_id", "text"), [(i, t) for i, _, _, t in brute.line_dedup(rows, line_dedup.MAX_RATIO, line_dedup.MIN_PAGES)])
        if name == "jaccard_join":
            same(plain(after, "doc_id"), [(i,) for i, _, root in brute.jaccard([(i, t) for i, _, t in rows], 5, 80) if i == root])
        if name == "decontaminate":
            items = plain(spark.read.parquet(f"{sf}/benchmark.parquet"), "item_id", "text")
            hit = {i: (n, h) for i, n, h, _ in brute.leaks([(i, t) for i, _, t in rows], items)}
            left = {i: len(brute.WORD.findall((t or "").encode().lower().decode())) for i, t in plain(after, "doc_id", "text")}
            assert left == {i: n - h for i, (n, h) in hit.items()}
            assert {i: t for i, t in plain(after, "doc_id", "text") if not hit[i][1]} == {i: t for i, _, t in rows if not hit[i][1]}
        before = after
    assert names == ["toxicity", "line_dedup", "jaccard_join", "decontaminate"]
    want = []
    for i, t in plain(before, "doc_id", "text"):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha(t or "")))
    same(plain(P.run(spark, sf), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), want)
