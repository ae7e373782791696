import gc
import glob
import hashlib
import os
import random
import re
import subprocess
import sys
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loamspark.llm import bpe, brown, common, fst_count, html_extract, jaccard_groups, line_dedup, mixing, queries, quality_rff, repetition
from loamspark.llm.common import bit_filter, cut, drop_keys
from loamspark.llm.components import components
from loamspark.llm.exact_dedup import exact_dedup

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
P = pytest.importorskip("public_tokenizers")


def key(row):
    return tuple(str(round(v, 6)) if isinstance(v, float) else str(v) for _, v in sorted(row.items()))


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = con.sql(queries.oracle_sql()[name])
    want = sorted(key(dict(zip(want.columns, r))) for r in want.fetchall())
    assert sorted(key(r.asDict()) for r in queries.queries()[name](spark, SF).collect()) == want


#: Nulls, empties, ties, repeated rows, a long text, columns whose names clash with the operators' own.
ROWS = [(1, "Abc def ghi", "s", 5), (2, "abc DEF ghi", "s", 6), (3, None, None, 7), (4, "", "t", 8), (5, "É é " * 3000, "t", 9), (5, "É é " * 3000, "t", 9), (None, "abc def ghi", "s", 1)]
SCHEMA = "doc_id long, text string, source string, `DOC_ID` long, id long, h string, size long, kept string, sid long, row long, words long, score double, target double, component_id long, at long, n long"


def messy(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 1, "x", 2, "y", 3, 4, 5, 0.5, 0.5, 6, 7, 8) for r in rows], SCHEMA)


OPERATORS = {
    "exact": lambda d: exact_dedup(d), "rules": repetition.quality_rules, "tokens": lambda d: fst_count.fst_token_counts(d, P.path("piece_bpe_32k.model")),
    "bpe": lambda d: bpe.bpe_encode(d, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), "mix": mixing.mix, "lines": line_dedup.line_dedup, "near": jaccard_groups.near_components, "lm": brown.lm_scores,
    "quality": lambda d: quality_rff.quality_scores(d, d.sparkSession.createDataFrame([], "doc_id long, quality int")),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_messy_and_empty_tables(spark, name):
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        rows, none = messy(spark), messy(spark, [])
        n = OPERATORS[name](rows).count()
        assert n == 7
        assert OPERATORS[name](none).count() == 0
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_exact_dedup_keeps(spark):
    rows = spark.createDataFrame([(1, "A"), (2, "a"), (3, "É"), (4, "é"), (5, None), (6, "")], "doc_id long, text string")
    assert {r.doc_id: r.keep_id for r in exact_dedup(rows).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5}
    assert {r.doc_id: r.keep_id for r in exact_dedup(rows, keep="largest").collect()} == {1: 2, 2: 2, 3: 3, 4: 4, 5: 6, 6: 6}


def brute_components(rows, n, percent):
    sets = {}
    for d, t in rows:
        w = WORDS.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    of = {d: d for d in sets}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                of[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}


@pytest.mark.parametrize("n, percent, members", [(3, 90, 256), (5, 80, 2), (1, 50, 3)])
def test_near_components(spark, n, percent, members):
    rnd = random.Random(n)
    bases = [[rnd.choice("abcdefghijklmnop") * rnd.randint(1, 3) for _ in range(rnd.randint(1, 60))] for _ in range(8)]
    rows = []
    for d in range(140):
        w = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4, 9])):
            w[rnd.randrange(len(w))] = rnd.choice("uvwxyz")
        rows.append((d, " ".join(w)))
    rows += [(200, None), (201, " \n"), (202, "One")]
    got = jaccard_groups.near_components(spark.createDataFrame(rows, "doc_id long, text string"), n, percent, members).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, n, percent)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("edits, long_list", [(1, 256), (1, 0), (2, 0)])
def test_line_dedup(spark, edits, long_list):
    rnd = random.Random(edits)
    bases = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randint(6, 30))) for _ in range(5)]

    def changed(x):
        for _ in range(rnd.randint(0, 4)):
            i = rnd.randint(0, len(x))
            x = x[:i] + rnd.choice(["", "é", "b"]) + x[i + rnd.randint(0, 1) :]
        return x

    docs = [(d, "\n".join(changed(rnd.choice(bases)) for _ in range(rnd.randint(0, 5)))) for d in range(40)] + [(90, None), (91, "")]
    first = {}
    for d, t in docs:
        for i, x in enumerate((t or "").split("\n")):
            if len(x) >= 5:
                first.setdefault(x, (d, i))
    late = {x for x in first if any(first[y] < first[x] and distance(x, y) <= edits for y in first)}
    stays = lambda d, i, x: x not in first or (first[x] == (d, i) and x not in late)
    want = {d: t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if stays(d, i, x)) for d, t in docs}
    got = line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string"), edits, 5, long_list=long_list).collect()
    assert {r.doc_id: r.text for r in got} == want


def test_exact_copies_of_short_lines(spark):
    long = "a line of more than twenty-four characters"
    docs = [(1, f"Short.\n\n{long}\nx"), (2, f"Short.\n\n{long}!\n \nShort"), (3, "y\n \nx\nShort.")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = lambda **more: {r.doc_id: r.text for r in line_dedup.line_dedup(df, **more).collect()}
    assert got(short_copies=True) == {1: docs[0][1], 2: "\n \nShort", 3: "y\n "}
    assert got() == {1: docs[0][1], 2: "Short.\n\n \nShort", 3: docs[2][1]}
    import corpus_pipeline

    piped = corpus_pipeline.drop_lines(spark, df.selectExpr("*", "'en' AS lang", "'s' AS source", "1L AS n_chars"), SF)
    assert {r.doc_id: r.text for r in piped.collect()} == got(short_copies=True)


def test_lone_lines_are_shuffled_once(spark):
    rnd = random.Random(3)
    docs = [(d, "\n".join("".join(rnd.choice("abcdefghijklmnop ") for _ in range(60)) for _ in range(20))) for d in range(400)]
    df = cut(spark.createDataFrame(docs, "doc_id long, text string"))
    spent = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = spent()
    assert {r.doc_id: r.text for r in line_dedup.line_dedup(df, short_copies=True).collect()} == dict(docs)
    assert spent() - before < 200 * 8000


def test_repetition_against_brute_force():
    rnd = random.Random(2)
    for _ in range(60):
        words = [rnd.choice("abc") for _ in range(rnd.randint(0, 40))]
        far = repetition.longest_repeats(np.array([ord(w) for w in words], np.int64), np.zeros(len(words), np.int64)).tolist()
        run = lambda i, j: next((k for k in range(len(words)) if j + k >= len(words) or words[i + k] != words[j + k]), 0)
        assert far == [max((run(min(i, j), max(i, j)) for j in range(len(words)) if j != i), default=0) for i in range(len(words))]


def test_rules(spark):
    clean = " ".join(f"w{i}" for i in range(100))
    junk = "buy now cheap pills today only " * 20
    got = {r.doc_id: r for r in repetition.quality_rules(spark.createDataFrame([(1, clean), (2, junk), (3, "a\nb \na\n\n#$")], "doc_id long, text string")).collect()}
    assert got[1].kept and not got[2].kept and got[2].base_failed and got[3].n_dup_lines == 1 and got[3].n_symbols == 2 and got[3].word_chars == 5


def test_tokenizers_equal_the_libraries():
    import sentencepiece
    import tiktoken

    ranks = bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec, rnd = bpe.Codec(ranks, P.PATTERN), random.Random(4)
    counter, library = fst_count.Counter(P.path("piece_bpe_32k.model")), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    texts = ["".join(rnd.choice("abcdefghilnorst   \n\té漢字'▁.!\x1c\x85😀Ж<s>0x") for _ in range(rnd.randint(0, 80))) for _ in range(2000)] + ["", "ab" * 20000, " " * 500, "<s></s><0x0A>"]
    packed = codec.encode(texts)
    assert codec.decode(pa.array([np.frombuffer(x, np.int32) for x in packed], pa.list_(pa.int32()))).to_pylist() == [t.encode() for t in texts]
    for t, ids in zip(texts, packed):
        assert np.frombuffer(ids, np.int32).tolist() == want.encode_ordinary(t)
        assert counter.count(t) == len(library.encode(t))


def test_counts_of_texts_cut_inside_words():
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    library, rnd = sentencepiece.SentencePieceProcessor(model_file=path), random.Random(5)
    texts = ["".join(rnd.choice("abcdefghilnorst" * 4 + "   \n\té漢'▁.😀Ж0x") for _ in range(rnd.randint(0, 300))) for _ in range(400)] + [" " * 100, "\n" * 70, "a" * 500]
    for piece in (1, 2, 7, 64):
        counter = fst_count.Counter(path, piece)
        assert [counter.count(t) for t in texts] == [len(library.encode(t)) for t in texts]
    word = "".join(rnd.choice("etaoinshrdlu") for _ in range(5000)) * 200
    assert fst_count.Counter(path).count(word) == len(library.encode(word))


def test_counting_goes_on_when_the_memory_is_full(monkeypatch):
    import sentencepiece

    monkeypatch.setattr(fst_count, "STATES", 50)
    path = P.path("piece_bpe_32k.model")
    counter, library, rnd = fst_count.Counter(path, 16), sentencepiece.SentencePieceProcessor(model_file=path), random.Random(6)
    for _ in range(100):
        t = "".join(rnd.choice("etaoinshrdlu ") for _ in range(rnd.randint(0, 200)))
        assert counter.count(t) == len(library.encode(t))


def test_class_model_is_a_distribution(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choice(["the cat", "a dog", "the dog sat", "RUNS"]) for _ in range(rnd.randint(0, 9)))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = brown.lm_scores(df, classes=3, exchange_words=4, held=5).collect()
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    counts = {}
    for t in train:
        for w in [*t.lower().split(), ""]:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for r in got:
        words = [*rows[r.doc_id][1].lower().split(), ""]
        base = sum(np.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        assert r.train_tokens == n and r.n_tokens == len(words) and abs(r.base_score - base) < 1e-6
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
    texts = df.where(~brown.held_out(F.col("doc_id"))).select("text")
    model = brown.fit(texts, brown.word_counts(texts), 3, 4, 100, 2, 0.9)
    one = model.score([w for w in model.words if w] + [b"unseen", b""])
    after_start = sum(10 ** (s - e) for s, e in zip(one["score"][:-1], [0] * len(model.words)))
    assert 0 < after_start < 1  # words then their ends: less than all
    assert sum(model.steps[0]) == pytest.approx(1)


def test_every_repeated_word_has_a_class(spark):
    rnd = random.Random(7)
    animals, verbs = [f"animal{i}" for i in range(30)], [f"verb{i}" for i in range(30)]
    rows = [(i, " ".join(f"the {rnd.choice(animals)} will {rnd.choice(verbs)}" for _ in range(5))) for i in range(300)] + [(1000, "once")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = df.select("text")
    counts = brown.word_counts(texts)
    models = [brown.fit(texts, counts, 8, 3 + 12, held, 4, 0.9) for held in (1000, 40)]
    model = models[0]
    of = {w.decode(): int(model.of[i]) for w, i in model.words.items()}
    rare = len(model.steps) - 1
    assert of["once"] == rare and all(of[w] != rare for w in animals + verbs) and not {of[w] for w in animals} & {of[w] for w in verbs}
    # Classes that reach the texts by the join count the same bigrams as those the workers hold.
    assert len(models[1].words) < len(model.words) and np.allclose(models[1].steps, model.steps)
    scores = [{r.doc_id: (r.n_known, r.base_score, r.score) for r in brown.lm_scores(df, 8, 15, held).collect()} for held in (1000, 40)]
    assert scores[0].keys() == scores[1].keys() and all(np.allclose(scores[0][d], scores[1][d]) for d in scores[0])


def test_scores_equal_a_slow_model(spark):
    rnd = random.Random(9)
    rows = [(i, " ".join(f"the {rnd.choice('abcdef')}{rnd.randint(0, 9)} will {rnd.choice('uvwxyz')}{rnd.randint(0, 9)}" for _ in range(rnd.randint(0, 6)))) for i in range(150)] + [(900, None), (901, "never seen before"), (None, "the a1")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    train = df.where(~brown.held_out(F.col("doc_id"))).select("text")
    m = brown.fit(train, brown.word_counts(train), 6, 20, 1000, 4, 0.9)
    of = {w: (int(m.of[i]), float(m.c[i])) for w, i in m.words.items()}
    rare = len(m.steps) - 1
    want = []
    for i, t in rows:
        before, total = 0, 0.0
        for w in [*(t or "").lower().encode().split(), b""]:
            g, c = of.get(w, (rare, 0.0))
            base = (c + 0.5) / (m.n + 0.5 * (m.v + 1))
            inner = (c + 0.5) / m.rare if g == rare else c / m.sizes[g]
            total += np.log10(0.9 * m.steps[before, g] * inner + 0.1 * base)
            before = g
        want.append((str(i), round(total, 6)))
    got = brown.lm_scores(df, 6, 20, 1000)
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in got.collect()) == sorted(want)
    held = got.where("held_out AND n_tokens > 1").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]  # a lower perplexity than single words' on texts that weren't learnt


def test_classes_grow_with_the_words(spark):
    texts = spark.createDataFrame([(" ".join(f"w{i}" for i in range(1000)),)] * 2, "text string")
    assert len(brown.fit(texts, brown.word_counts(texts), 4, 8, 100, 1, 0.9).steps) == 12


def test_words_as_common_as_others_fill_the_room(spark):
    counts = spark.createDataFrame([(f"w{i}".encode(), 2) for i in range(1000)] + [(b"", 5), (b"the", 9)], "word binary, c long")
    words, c, _ = brown.most_frequent(counts, 100)
    assert words[:2] == [b"", b"the"] and 90 < len(words) <= 101 and c.tolist() == [5, 9] + [2] * (len(words) - 2)


def test_workers_score_few_tokens_at_a_time():
    lists = pa.RecordBatch.from_arrays([pa.array([[1] * 300] * 50 + [[]] + [[1] * 5000])], names=["ids"])
    got = [pa.compute.sum(pa.compute.list_value_length(b.column(0))).as_py() for b in common.slices(iter([lists]), 0, 1000)]
    assert sum(got) == 20_000 and sorted(got)[-1] == 5000 and sorted(got)[-2] < 1000 + 300


def test_quality_learns(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8)))
    rows = [(i, " ".join(word() if i % 3 else word().upper() + "!!" for _ in range(60))) for i in range(600)]
    df, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(600)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = quality_rff.quality_scores(df, labels).collect()
    held = [r for r in got if r.held_out]
    assert held and all(r.predicted == int(r.doc_id % 3 > 0) for r in held) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert {r.doc_id for r in quality_rff.quality_filter(df, labels).collect()} == {r.doc_id for r in got if r.predicted}
    assert [round(m, 3) for _, _, m in quality_rff.isotonic(np.array([1, 1, 0, 2]), np.array([1, 0, 0, 2]))] == [0.5, 1.0]


def test_html():
    page = """<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><a href="/">Home</a></nav><div class="cookie-notice">We use the cookies of this site to be with you.</div>
    <article><h1>Head &amp; tail</h1><p>One <b>two</b>&nbsp; three<br>four.<p>Short.</p><div class="ad">Buy the best of all of it now, it is for you and for them.</div><pre>x  y</pre></article><div id="comments"><p>The first of the comments was that it is not on.</p></div><footer>&copy; me</footer></body></html>"""
    assert html_extract.main_text(page) == "Head & tail\n\nOne two three four.\n\nShort.\n\nx y"
    plain = "<body><ul><li><a href=x>Menu</a></li></ul><h2>Title</h2><p>" + "It is the story of a man and the sea, and of what he was to find there. " * 2 + "</p><p>End.</p></body>"
    assert html_extract.main_text(plain).startswith("Title\n\nIt is") and html_extract.main_text(plain).endswith("End.")
    assert html_extract.main_text(None) == ""


def test_html_without_marks():
    pages = [r[0] for r in duckdb.sql(f"SELECT html FROM '{SF}/pages.parquet' WHERE html IS NOT NULL").fetchall()]
    whole = [html_extract.main_text(x) for x in pages]
    assert sum(html_extract.main_text(re.sub("</?article>", "", x)) == y for x, y in zip(pages, whole)) >= 0.96 * len(pages)
    assert html_extract.main_text("<body><p>日本語の文章です。</p><p>二番目。</p></body>") == "日本語の文章です。\n\n二番目。"
    assert html_extract.main_text('<article><script src=//x.y/z/>var a=1;</script><p>A &lt;b&gt; c < d.</p><p class="social-history">Kept.</p><div class="site-footer">Gone.</div></article>') == "A <b> c < d.\n\nKept."
    assert html_extract.named_boilerplate("x ad-300x250") and html_extract.named_boilerplate("cookieNotice") and not html_extract.named_boilerplate("advice comment-free")


def test_html_takes_linear_time():
    for page in ("<a " * 350_000, '<a b="' * 170_000, "<" * 500_000, "<!-- " * 200_000, "<script>" * 120_000, '<a b="' * 85_000 + "<a c='" * 85_000 + ">"):
        start = time.process_time()
        html_extract.main_text(page)
        assert time.process_time() - start < 3


def test_html_table(spark):
    rows = spark.createDataFrame([(1, "u", "<article><p>a</p></article>"), (None, None, None)], "page_id long, url string, html string")
    assert {(r.page_id, r.text, r.n_chars) for r in html_extract.extract_html(rows).collect()} == {(1, "a", 1), (None, "", 0)}


def test_small_checkpoints_are_read_by_few_tasks(spark):
    few = 2 * spark.sparkContext.defaultParallelism
    rows = spark.range(1000).repartition(211)
    got = cut(rows)
    assert got.rdd.getNumPartitions() == few and sorted(r.id for r in got.collect()) == [*range(1000)]
    wide = spark.range(10 * few, numPartitions=5 * few).select("id", F.expr(f"array_join(transform(sequence(0, {common.SMALL // 32}), i -> sha2(string(id * 100000 + i), 256)), '')").alias("x"))
    assert cut(wide).rdd.getNumPartitions() == 5 * few  # large ones stay apart


def test_release_hands_back_memory_outside_the_heap(spark):
    jvm = spark.sparkContext._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()

    def held() -> int:
        """KB of the C library's pools, which begin at multiples of 64 MB."""
        total, inside = 0, False
        for line in open(f"/proc/{pid}/smaps"):
            if m := re.match(r"([0-9a-f]+)-([0-9a-f]+) rw-p \S+ \S+ 0\s*(\[heap\])?$", line):
                start, end = int(m[1], 16), int(m[2], 16)
                inside = bool(m[3]) or start > 1 << 32 and start % (1 << 26) == 0 and end - start <= 1 << 26
            elif re.match("[0-9a-f]+-", line):
                inside = False
            elif inside and line.startswith("Anonymous:"):
                total += int(line.split()[1])
        return total

    blocks = [jvm.java.nio.ByteBuffer.allocateDirect(1 << 16) for _ in range(1600)]
    last = blocks.pop()  # above the others, so that nothing falls off the end
    del blocks
    for _ in range(3):
        gc.collect()
        jvm.System.gc()
        time.sleep(0.5)
    before = held()
    common.release(spark)
    assert before - held() > 50 << 10 and last.capacity() == 1 << 16


#: An executor fills its heap and is idle then; MB that its process holds before and after.
EXECUTOR = """
import re
import time
from pyspark.sql import SparkSession, functions as F
from loamspark.llm import common
spark = SparkSession.builder.config(map={"spark.master": "local-cluster[1,1,1000]", "spark.executor.memory": "800m", "spark.ui.enabled": "false",
    "spark.executor.extraJavaOptions": "-XX:+UseG1GC", "spark.driver.bindAddress": "127.0.0.1", "spark.driver.host": "127.0.0.1"}).getOrCreate()
jvm = spark.sparkContext._jvm.java.lang.ProcessHandle.current()
def held():
    return sum(int(re.search(r"VmRSS:\\s+(\\d+)", open(f"/proc/{p.pid()}/status").read())[1]) >> 10 for p in jvm.children().toArray() if b"CoarseGrained" in open(f"/proc/{p.pid()}/cmdline", "rb").read())
spark.range(0, 2, 1, 1).select(F.size(F.array_repeat(F.col("id"), 50000000))).collect()
before = held()
n = common.shrink(spark)
time.sleep(3)  # the heap goes back in the background
print("HELD", n, before, held())
"""


def test_idle_executors_hand_back_their_heap(tmp_path):
    import pyspark

    home = tmp_path / "home"  # executors work in a folder of Spark's home
    (home / "work").mkdir(parents=True)
    for x in os.listdir(os.path.dirname(pyspark.__file__)):
        if x != "work":
            (home / x).symlink_to(f"{os.path.dirname(pyspark.__file__)}/{x}")
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_DIRS": str(tmp_path)}
    env = {k: v for k, v in env.items() if k not in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    said = subprocess.run([sys.executable, "-c", EXECUTOR], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert "HELD" in said.stdout, said.stderr[-2000:]
    n, before, after = map(int, said.stdout.split("HELD")[1].split())
    assert n == 1 and before - after > 100


def test_idle_workers_hand_back_memory(spark):
    def run(batches):
        for b in batches:
            blocks = [bytearray(1 << 16) for _ in range(1600)]
            sys.last = blocks.pop()  # above the others, so that nothing falls off the end
            del blocks
            yield b

    def held(batches):
        for b in batches:
            kept = int(re.search(r"Anonymous:\s+(\d+)", open("/proc/self/smaps_rollup").read())[1])
            yield pa.RecordBatch.from_arrays([pa.array([kept] * b.num_rows, pa.int64())], names=["id"])

    def after(f):
        rows = spark.range(1, numPartitions=1)
        rows.mapInArrow(f, "id long").collect()
        return rows.mapInArrow(held, "id long").first().id

    assert after(run) - after(common.thrifty(run)) > 50 << 10


def test_bitmaps_lose_nothing(spark):
    rows = spark.range(5000)
    some = spark.range(0, 5000, 7)
    kept = bit_filter(rows, F.xxhash64("id"), some.select(F.xxhash64("id").alias("k")), 715)
    assert kept.join(some, "id").count() == 715 and kept.count() < 1500
    assert drop_keys(rows, F.col("id"), some, 715).count() == 5000 - 715


def test_pipeline_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).checkpoint()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() > 0, name
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(out) == docs.count() and all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and r.n_tokens == len(r.ids) for r in out)


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")


def text_of(start, n=60):
    return " ".join(f"w{start + i}" for i in range(n))


def test_near_copy_stage_keeps_clean_rows(spark):
    import corpus_pipeline

    a, b, c = text_of(0), text_of(1000), text_of(2000)
    near = a.replace("w59", "x")
    rows = [(1, a, "s"), (2, near, "s"), (2, b, "s"), (None, near, "s"), (None, c, "s"), (3, "", "s"), (4, None, "s"), (5, "", "s"), (7, text_of(3000), "s"), (7, text_of(3000), "s"), (None, text_of(4000), "s"), (None, text_of(4000), "s")]
    got = corpus_pipeline.drop_near_copies(spark, docs_of(spark, rows), SF)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    want = [(1, a), (2, b), (None, c), (3, ""), (4, None), (5, ""), (7, text_of(3000)), (None, text_of(4000))]
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, want))
    assert corpus_pipeline.drop_near_copies(spark, docs_of(spark, []), SF).count() == 0


def test_mix_stage_repeats_rows_alike(spark):
    import corpus_pipeline

    rows = [(1, text_of(0), "a"), (1, text_of(0), "a"), (1, text_of(9), "a"), (None, text_of(1), "a"), (None, text_of(2), "b"), (None, None, "b"), (2, "", "b"), (3, text_of(3), None)]
    docs = docs_of(spark, rows)
    taken = {}
    for r in mixing.mix(docs, text_hash=True).collect():
        taken.setdefault((r.doc_id, r.text_hash), []).append((r.taken, r.size))
    assert sum(map(len, taken.values())) == len(rows)
    got = corpus_pipeline.mix_sources(spark, docs, SF)
    assert got.columns == docs.columns
    found = {}
    for r in got.withColumn("h", F.xxhash64("text")).collect():
        found[r.doc_id, r.h] = found.get((r.doc_id, r.h), 0) + 1
    want = {k: len(v) * int(sum(t for t, _ in v) / sum(s for _, s in v) + 0.5) for k, v in taken.items() if sum(t for t, _ in v)}
    assert found == {k: n for k, n in want.items() if n}
    assert corpus_pipeline.mix_sources(spark, docs_of(spark, []), SF).count() == 0


def test_mix_follows_its_schedule(spark, monkeypatch):
    rows = [(i, text_of(i, 300), "abc"[i % 3]) for i in range(60)] + [(99, None, "a"), (99, None, "a")]
    docs = docs_of(spark, rows)
    got = mixing.mix(docs, block=16).collect()
    assert len(got) == 62 and all(r.taken <= 2 * r.size and (r.first_slot is None) == (r.taken == 0) for r in got)
    for size in {r.source_size for r in got}:
        mine = [r for r in got if r.source_size == size]
        assert abs(sum(r.taken for r in mine) - sum({r.target for r in mine})) <= 1
    real = mixing.schedule
    monkeypatch.setattr(mixing, "schedule", lambda sources, quotas: real(sources, quotas).where("false"))
    assert all(r.taken == 0 for r in mixing.mix(docs, block=16).collect())


def test_normal_equations_equal_one_product(spark):
    r = np.random.default_rng(3)
    d, features = len(quality_rff.STATISTICS), 6
    x, y, fold = r.normal(size=(200, d)), r.uniform(size=200), r.integers(0, quality_rff.FOLDS, 200)
    model = quality_rff.Model(np.zeros(d), np.ones(d), r.normal(size=(d, features)), r.uniform(size=features), np.zeros(features + 1), np.array([0.0]), np.array([0.0]))
    z = np.column_stack([model.features(x), y])
    rows = spark.createDataFrame([(a.tolist(), float(b), int(k)) for a, b, k in zip(x, y, fold)], "x array<double>, y double, fold int")
    for parts in (1, 90):  # partitions that sum, and partitions with too few rows to
        got = quality_rff.normal_equations(rows.repartition(parts), model)
        for k in range(quality_rff.FOLDS):
            assert np.allclose(got[k], z[fold == k].T @ z[fold == k])
    assert not quality_rff.normal_equations(rows.limit(0), model).any()
