"""The corpus operators against brute force on small tables, and on awkward rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strataloom.llm import chat_format, exact_dedup, golomb, html_extraction, language_id, line_dedup, minhash, packing, piece_tokens, quality_rules, suffix_dedup
from strataloom.llm.queries import QUERIES, tokenizer_path

WORD = r"[^\x20\x09-\x0D]+"
DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _text string, kept string, key string, _sha string"


def prose(seed, n=80):
    r = np.random.default_rng(seed)
    words = ["".join(r.choice(list("abcdefgh"), 3)) for _ in range(40)]
    return " ".join(r.choice(words, n)) + "."


AWKWARD = [
    (1, "", "en"), (2, None, "en"), (3, " \t\n ", None), (4, prose(1), "en"), (5, prose(1), "en"), (6, prose(1).replace(" ", "  \n"), "en"), (6, prose(1), "en"),
    (7, prose(2, 30_000), "fr"), (None, prose(3), "en"), (None, None, None), (8, "x", "de"), (9, "a_b ... ,, 日本語 é \U0001f600 <|endoftext|>", "de"), (10, prose(2, 30_000)[5000:9000], "fr"),
    (11, prose(4) + "\n" + prose(5) + "\n" + prose(6) + "\n" + prose(7) + "\n" + prose(8), "en"), (12, "lead\n" + prose(4) + "\n" + prose(5) + "\n" + prose(6) + "\n" + prose(7) + "\n" + prose(8), "en"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, "src", len(t or ""), "clash", "clash", "clash", "clash") for i, t, lang in AWKWARD], DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def sample(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def texts_of(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


def equal(got, want):
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_golomb():
    r = np.random.default_rng(0)
    for n, bits in ((0, 20), (1, 64), (5000, 30), (5000, 64), (300, 9)):
        values = np.unique(r.integers(0, 1 << min(bits, 63), n, dtype=np.uint64))
        assert np.array_equal(golomb.decode(golomb.encode(values, bits)), values)


# 1: html


def test_main_text():
    page = (
        "<html><head><title>No</title><script>if (a<b) '</p>'</script><style>p{}</style></head><body><header>Top</header><nav><ul><li>Menu</ul></nav><div class='side-bar'>Side</div>"
        "<article><h1>Ti&amp;tle</h1><p>One <b>bo</b>ld<br>two&nbsp;&lt;x&gt;\n three.<p class=notice>Cookie<p>Four.<form>Search</form><div class=\"ad\">Buy</div><ul><li>a<li>b</ul></article>"
        "<section id=comments><article>Nice post, really very nice, thanks.</article></section><footer>End</footer><!-- p --></body>"
    )
    assert html_extraction.main_text(page) == "Ti&tle\nOne bold two <x> three.\nFour.\na\nb"
    assert html_extraction.main_text("<article><p>A <button>Like</button>b<div class=cookieBanner>C</div><div class='content free'>d</article>") == "A b\nd"
    assert html_extraction.main_text("<main><p>Latest<article><h1>T</h1><p>One, two, three; four.<p>Five, six.</article><p>More</main>") == "T\nOne, two, three; four.\nFive, six."
    body = "".join(f"<p>Sentence {k}, with enough words, and marks; to count as text.</p>" for k in range(6))
    plain = f"<body><div><a href=x>Home</a></div><div class=content>{body}</div><div><a>Next</a></div></body>"
    assert html_extraction.main_text(plain).count("\n") == 5 and "Home" not in html_extraction.main_text(plain)
    for bad in (None, "", "<", "<p", "<!--", "<script>", "</p></p>", "<p a='", "plain text"):
        html_extraction.main_text(bad)


SENTENCES = [f"Sentence {k}, with enough words, and marks; to count as text in a long paragraph." for k in range(5)]
BODY, TEXT = "".join(f"<p>{x}</p>" for x in SENTENCES), "\n".join(SENTENCES)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<article title="the hidden city">{BODY}</article>', TEXT),
        (f'<article>{BODY}<p data-t="a hidden gem">kept, yes.</p></article>', TEXT + "\nkept, yes."),
        *((f'<body><div class="{c}">{BODY}</div><footer>x</footer></body>', TEXT) for c in ("content has-sidebar", "no-comments", "with-nav", "banner-title", "layout no-sidebar", "sidebar", "nav")),
        (f'<article>{BODY}<section id="related-work"><h2>Related work</h2><p>Others, too; did this.</p></section></article>', TEXT + "\nRelated work\nOthers, too; did this."),
        (f'<article>{BODY}<ol class="commentlist"><li>Nice, post; indeed a very long one.</li></ol></article>', TEXT),
        (f'<div class=content>{BODY}</div><ol class="commentlist"><li><p>Nice, post; indeed a very long one.</li></ol>', TEXT),
        (f'<body><div id=main>{BODY}</div><section class="post-comments">{BODY * 3}</section></body>', TEXT),
        (f"<article><h1>Head</h1><p>Lead, first; text that leads.</p><div itemprop=articleBody>{BODY}</div></article>", "Head\nLead, first; text that leads.\n" + TEXT),
        (f"<main><article>{BODY}</article><article>{BODY}</article></main>", TEXT + "\n" + TEXT),
        (f'<article>{BODY}<div class="related-posts"><a href=x>Other</a></div></article>', TEXT),
        (f"<article>{BODY}<ul><li><a href=1>One link</a><li><a href=2>Two link</a></ul></article>", TEXT),
        (f"<article><h1><a href=x>Head line</a></h1>{BODY}</article>", "Head line\n" + TEXT),
        (f"<body><div id=top><a>Home</a> <a>News</a></div><div id=mid><h2>Head</h2>{BODY}<ul><li>first item</li><li>second item</li></ul></div><div id=bot>Copyright 2020</div></body>", f"Head\n{TEXT}\nfirst item\nsecond item"),
        (f"<table><tr><td class=menu><a>A</a><td>{BODY}</td></tr></table>", TEXT),
        (f"<body><h1>Head</h1>{BODY}<div>Copyright</div></body>", "Head\n" + TEXT),
        (f'<article>{BODY}<div hidden>no</div><div style="display: none">no</div><div aria-hidden="true">no</div></article>', TEXT),
        (f"<main><h1>Head</h1><article>{BODY}</article><p>Latest</main>", "Head\n" + TEXT),
    ],
)
def test_page_shapes(page, want):
    assert html_extraction.main_text(page) == want


def test_pages(spark):
    assert html_extraction.extract_pages(spark.createDataFrame([], "page_id long, url string, html string, text string")).count() == 0
    rows = spark.createDataFrame([(1, "u", "<article>hi</article>", "x"), (None, None, None, "x"), (1, "u", "<article>hi</article>", "x")], "page_id long, url string, html string, text string")
    equal([tuple(r) for r in html_extraction.extract_pages(rows).collect()], [(1, "u", "hi", 2), (1, "u", "hi", 2), (None, None, "", 0)])
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = {r.page_id: r for r in html_extraction.extract_pages(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        import html

        want = "\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner)) if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


# 2: language


def test_language(spark, sample, docs, empty):
    rows = language_id.language_id(sample).join(sample.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows) and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.9
    odd = language_id.language_id(docs).collect()
    assert len(odd) == len(AWKWARD) and {r.lang_pred for r in odd if r.doc_id in (1, 2, 3)} == {"und"}
    assert language_id.language_id(empty).count() == 0
    blind = language_id.language_id(sample.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in blind} == {"und"}


def test_language_of_repeated_ids(spark, sample):
    """An id that repeats is learnt from once; a column with the name of a result does not clash."""
    one = sample.where("lang = 'en' and crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1").limit(1)
    more = sample.unionByName(spark.range(500).crossJoin(one).drop("id")).withColumn("score", F.lit("clash")).withColumn("_lang", F.lit("clash"))
    want = {r.doc_id: (r.lang_pred, r.score) for r in language_id.language_id(sample).collect()}
    got = language_id.language_id(more).collect()
    assert len(got) == sample.count() + 500 and all(want[r.doc_id] == (r.lang_pred, pytest.approx(r.score, abs=1e-4)) for r in got)


def test_kernel_by_brute_force():
    texts = ["Hello, World", "hullo wurld", "x"]
    rows = np.zeros((3, 1 << language_id.SLOT_BITS), np.float32)
    assert language_id.presence([*texts], language_id.letter_table(), rows).all()
    grams = lambda t: {t[i : i + n] for n in range(1, 5) for i in range(len(t) - n + 1)}
    odd = np.zeros((3, 1 << language_id.SLOT_BITS), np.float32)
    assert language_id.presence(["\U0001f600 12.", "\U00020000", ""], language_id.letter_table(), odd).tolist() == [False, True, False]
    clean = [re.sub(r"[^a-z]", " ", t.lower()) for t in texts]
    for a in range(3):
        for b in range(3):
            assert abs(rows[a] @ rows[b] - len(grams(clean[a]) & grams(clean[b]))) <= 1  # two n-grams may share a slot


# 3: repeated strings


def brute_repeats(rows):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(t[k : k + 200] for _, t in data for k in range(len(t) - 199))
    out = []
    for i, t in data:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone[k : k + 200] = True
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((i, len(t), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return out


def test_repeats(spark, sample, docs, empty):
    rows = sample.where("length(text) < 6000")
    more = prose(50, 200)
    extra = [(9001, more[:450] + "|" + more[100:300] + "é"), (9002, "é" + more[:199]), (9003, "é" + more[:200]), (9004, "a" * 450), (9005, "b" * 200)]
    rows = rows.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    equal([tuple(r) for r in suffix_dedup.repeated_spans(rows).select(*columns).collect()], brute_repeats(texts_of(rows)))
    assert suffix_dedup.repeated_spans(empty).count() == 0 and suffix_dedup.repeated_spans(docs).count() == len(AWKWARD)
    kept = suffix_dedup.remove_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == len(AWKWARD)
    cut = {r.doc_id: r.text for r in kept.collect()}
    clash = docs.withColumn("_key", F.lit("k")).withColumn("_cut", F.lit("c"))
    equal([tuple(r) for r in suffix_dedup.remove_repeats(clash).drop("_key", "_cut").collect()], [tuple(r) for r in kept.collect()])
    assert {(r._key, r._cut) for r in suffix_dedup.remove_repeats(clash).collect()} == {("k", "c")}
    assert cut[10] == "" and cut[8] == "x" and cut[2] is None and cut[7].startswith(prose(2, 30_000)[:4000])


def far_ids(text_a, text_b, text_c):
    """Ids that a double cannot hold beside a missing one, and rows that repeat an id."""
    big = 1 << 60
    return [(big + 1, text_a), (big + 3, text_b), (None, text_a), (big + 2, text_c), (big + 2, text_b), (big + 2, None), (None, None)]


def test_repeats_of_far_ids(spark):
    one, two, other = prose(61, 200), prose(62, 200), prose(63, 30)
    rows = far_ids(one, "B" + one[:700] + two, other)
    for kind, make in (("long", lambda i: i), ("string", lambda i: None if i is None else f"x{i}")):
        frame = spark.createDataFrame([(make(i), t, "clash") for i, t in rows], f"doc_id {kind}, text string, _sha string").repartition(3)
        got = suffix_dedup.repeated_spans(frame).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        equal([tuple(r) for r in got.collect()], brute_repeats([(make(i), t) for i, t in rows]))


def test_names_that_collide(spark):
    """With names of 14 bits most candidates share one with other strings; bytes must decide."""
    base = [prose(70 + k, 120) for k in range(6)]
    rows = [(k, base[k % 6][: 300 + 7 * k] + prose(90 + k, 60) + base[(k + 1) % 6][50:]) for k in range(24)] + [(99, "a" * 450), (98, "ab" * 300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = suffix_dedup.repeated_spans(frame, name_bits=14).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    equal([tuple(r) for r in got.collect()], brute_repeats(rows))


def test_cover():
    assert {(a - b) % suffix_dedup.PERIOD for a in suffix_dedup.COVER for b in suffix_dedup.COVER} == set(range(suffix_dedup.PERIOD))


# 4: pieces


def test_pieces(spark, sample, docs, empty):
    path = tokenizer_path("piece_bpe_32k.model")
    rows = piece_tokens.encode_pieces(sample, path)
    assert rows.where("not round_trip").count() == 0
    back = {r.doc_id: r.text for r in piece_tokens.decode_pieces(rows, path).collect()}
    assert all(back[i] == t for i, t in texts_of(sample))
    odd = {r.doc_id: r for r in piece_tokens.encode_pieces(docs, path).collect()}
    assert odd[2].ids == [] and odd[9].round_trip and piece_tokens.encode_pieces(empty, path).count() == 0


def test_viterbi_by_brute_force():
    from sentencepiece import SentencePieceProcessor

    model = piece_tokens.PieceModel(tokenizer_path("piece_bpe_32k.model"))
    raw = model.processor.serialized_model_proto()
    for k in (j for j in range(len(raw) - 5000, len(raw)) if raw[j : j + 2] == b"\x18\x02"):  # the model kind, as one of unigram scores
        try:
            other = SentencePieceProcessor(model_proto=raw[:k] + b"\x18\x01" + raw[k + 2 :])
        except RuntimeError:
            continue
        if other.encode("Hello hellooo wonderful") != model.processor.encode("Hello hellooo wonderful"):
            break
    words = ["▁" + w for w in prose(9, 60).split()] + ["▁hellooo", "▁wonderful", "▁wonder", "▁日本", "▁é"]

    def best(word):
        table = [(0.0, ())] + [None] * len(word)
        for end in range(1, len(word) + 1):
            options = [(table[a][0] + model.pieces[word[a:end]][0], -a, table[a][1] + (model.pieces[word[a:end]][1],)) for a in range(end) if word[a:end] in model.pieces]
            if word[end - 1] not in model.pieces:
                ids = tuple(model.bytes[b] for b in word[end - 1].encode())
                options.append((table[end - 1][0] + model.unknown, 1 - end, table[end - 1][1] + ids))
            score, _, ids = max(options)
            table[end] = (score, ids)
        return table[-1][1]

    got = model.segment(words)
    assert all(got[w] == best(w) for w in words)
    for w in words[:60]:
        assert list(got[w]) == other.encode(w[1:])


# 5: quality


def base_counts(text):
    words = re.findall(WORD, text or "")
    seen = collections.Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    again = {k + j for k in range(len(words) - 2) if seen[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


def test_quality(spark, sample, docs, empty):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    for rows in (sample, docs):
        out = quality_rules.quality_rules(rows.select("doc_id", "text"), labels).collect()
        for r in out:
            n, chars, symbols, dup, again = base_counts(r.text)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, again)
            assert r.base_failed == (n < 50 or 100 * again > 50 * n) and not (r.kept and r.base_failed)
    assert quality_rules.quality_rules(empty, labels).count() == 0
    judged = quality_rules.quality_rules(sample, labels).join(labels, "doc_id").where("not base_failed").collect()
    assert all(r.kept for r in judged if r.quality == 1) and np.mean([r.kept for r in judged if r.quality == 0]) < 0.2
    assert quality_rules.quality_rules(sample, labels.where("quality = 1")).where("kept = base_failed").count() == 0


def test_score_by_brute_force(spark, sample):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    weights, _ = quality_rules.fit(sample, labels)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    word = lambda w: signed(xxhash.xxh64_intdigest(w.encode(), 42))
    long = lambda v, seed: signed(xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True), seed % (1 << 64)))
    features = lambda t: [h % quality_rules.FEATURES for hw in [[word(w) for w in re.findall(WORD, t or "")]] for h in hw + [long(b, long(a, 42)) for a, b in zip(hw, hw[1:])]]
    good = {r.doc_id for r in labels.where("quality = 1").collect()} - {r.doc_id for r in labels.where("quality = 0").collect()}
    raw, target = collections.Counter(), collections.Counter()
    for i, t in texts_of(sample):
        raw.update(features(t))
        target.update(features(t) if i in good else [])
    n = quality_rules.FEATURES
    want = [np.log((target[k] + 1) / (sum(target.values()) + n)) - np.log((raw[k] + 1) / (sum(raw.values()) + n)) for k in range(n)]
    assert np.allclose(weights, want)
    for r in quality_rules.quality_rules(sample, labels).select("text", "lr_score").collect():
        own = features(r.text)
        assert r.lr_score == pytest.approx(np.mean([want[k] for k in own]) if own else 0.0)


def test_split():
    assert quality_rules.split([(0.0, 0), (1.0, 1)]) == 0.5 and quality_rules.split([(0.0, 1)]) == float("-inf")
    assert quality_rules.split([(k / 10, 1) for k in range(10)] + [(0.5, 0)]) == float("-inf")


# 6: near duplicates


def brute_components(rows, percent=minhash.LINK_PERCENT):
    sets = []
    for i, t in rows:
        w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (i, a) in enumerate(sets):
        for y in range(x):
            j, b = sets[y]
            both = len(a & b)
            if a and b and i is not None and j is not None and 100 * both >= percent * (len(a) + len(b) - both):
                parent[root(x)] = root(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            least[root(x)] = min(i, least.get(root(x), i))
    return [(i, len(s), None if i is None else least[root(x)]) for x, (i, s) in enumerate(sets)]


def edited(seed, edits, n=150):
    words, r = prose(99, n).split(" "), np.random.default_rng(seed)
    for k in r.choice(n, edits, replace=False):
        words[k] = f"w{seed}x{k}"
    return " ".join(words)


def test_near_duplicates(spark, sample, docs, empty):
    near = [(20_000 + k, edited(k, k % 9)) for k in range(120)]
    rows = sample.select("doc_id", "text").where("length(text) < 4000").unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    for frame in (rows, docs):
        got = minhash.near_duplicates(frame).collect()
        equal([(r.doc_id, r.n_shingles, r.component_id) for r in got], brute_components(texts_of(frame)))
        assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert minhash.near_duplicates(empty).count() == 0


def test_near_rows_of_repeated_ids(spark):
    big = 1 << 60
    rows = [(big + 1, prose(1)), (big + 3, prose(1)), (None, prose(1)), (None, prose(1)), (5, prose(2)), (5, prose(3)), (5, prose(2)), (7, edited(1, 0)), (7, edited(2, 1)), (6, edited(3, 1)), (1, None), (1, "")]
    for kind, make in (("long", lambda i: i), ("string", lambda i: None if i is None else f"x{i}")):
        frame = spark.createDataFrame([(make(i), t, "clash") for i, t in rows], f"doc_id {kind}, text string, _row string").repartition(3)
        got = minhash.near_duplicates(frame).collect()
        equal([(r.doc_id, r.n_shingles, r.component_id) for r in got], brute_components([(make(i), t) for i, t in rows]))
        kept = minhash.keep_smallest(frame)
        assert kept.columns == frame.columns
        want = [(make(i), t) for i, t in (rows[0], rows[2], rows[3], rows[4], rows[5], rows[9], rows[10], rows[11])]
        equal([(r.doc_id, r.text) for r in kept.collect()], want)


def test_batches_of_long_texts(spark):
    """Several slices of one batch."""
    long = [(k, prose(1000 + k, 60_000)) for k in range(6)] + [(9, prose(1000, 60_000) + " more")]
    frame = spark.createDataFrame(long, "doc_id long, text string").coalesce(1)
    equal([(r.doc_id, r.component_id) for r in minhash.near_duplicates(frame).collect()], [(k, k) for k in range(6)] + [(9, 0)])


def test_recall_of_bands():
    """Of pairs between the limit and 0.92 nearly all share a band: the layout foretells 1.2e-5 missed at the limit itself."""
    r, missed, pairs = np.random.default_rng(11), 0, 0
    for n in (7, 20, 60, 200, 1000):
        for _ in range(400):
            both = math.ceil(n * r.uniform(0.92, 0.955))  # Jaccard of 0.852 to 0.914 for two sets of n with so many in common
            pool = r.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64) * np.uint64(2)
            sets = [np.sort(pool[:n]), np.sort(pool[n - both :])]
            sig = minhash.signatures(np.concatenate(sets), np.array([n, 2 * n])).reshape(2, minhash.BANDS, minhash.BAND_ROWS)
            if 100 * both >= 85 * (2 * n - both):
                pairs, missed = pairs + 1, missed + (not (sig[0] == sig[1]).all(axis=1).any())
    assert pairs > 1500 and missed <= 3


def test_parted_buckets(spark, monkeypatch):
    near = spark.createDataFrame([(k, edited(k, k % 9)) for k in range(60)], "doc_id long, text string")
    want = brute_components(texts_of(near))
    monkeypatch.setattr(minhash, "BLOCK_PAIRS", 20)
    monkeypatch.setattr(minhash, "CHUNK", 8)
    equal([(r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(near).collect()], want)


def test_links_in_large_buckets(spark, monkeypatch):
    """A similar pair with two bands in common, both in buckets that go past BLOCK_PAIRS and whose first member is a third text."""
    base = [f"u{k}" for k in range(1500)]
    other, r = list(base), np.random.default_rng(1456)
    for k, at in enumerate(r.integers(0, 1500 / 24, 24)):
        other[int(k * 62.5) + int(at * 0.9) + 2] = f"v1456x{k}"
    bands = lambda t: minhash.signatures(*minhash.Shingler().sets([t])).reshape(minhash.BANDS, minhash.BAND_ROWS)
    a, b = bands(" ".join(base)), bands(" ".join(other))
    common = np.flatnonzero((a == b).all(axis=1))
    assert len(common) == 2
    of = {minhash.Shingler().sets([" ".join(base[k : k + 5])])[0][0]: " ".join(base[k : k + 5]) for k in range(1496)}
    rows = [(10, " ".join(base)), (11, " ".join(other))]
    for at in common:  # short texts with the six shingles of a common band
        tries = (" ".join(f"{of[h]} f{seed}x{k}" for k, h in enumerate(a[at])) for seed in range(1000))
        rows.append((len(rows) - 1, next(t for t in tries if (bands(t)[at] == a[at]).all())))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    assert {i: c for i, _, c in want} == {10: 10, 11: 10, 1: 1, 2: 2}
    monkeypatch.setattr(minhash, "BLOCK_PAIRS", 0)
    for most in (16, 1):
        monkeypatch.setattr(minhash, "SMALL_GROUP", most, raising=False)
        equal([(r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame).collect()], want)


def test_other_limits(spark, sample):
    near = [(20_000 + k, edited(k, k % 9)) for k in range(60)]
    frame = sample.select("doc_id", "text").where("length(text) < 4000").unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    assert minhash.layout(85) == (minhash.BANDS, minhash.BAND_ROWS)
    assert brute_components(texts_of(frame), 80) != brute_components(texts_of(frame), 85)
    equal([(r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame, link_percent=80).collect()], brute_components(texts_of(frame), 80))


def test_densification_keeps_full_bins():
    hashes, ends = minhash.Shingler().sets(["a b c d e f", None, "x"])
    sig = minhash.signatures(hashes, ends)
    assert set(sig[0].tolist()) == set(hashes[: ends[0]].tolist()) and not sig[1].any() and set(sig[2].tolist()) == {hashes[-1]}


# 7: lines


def test_lines(spark, sample, docs, empty):
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    passage = "\n".join(f"line {k} of the passage" for k in range(12))
    more = [(9001, f"a\n{passage}\nb"), (9002, f"{passage}\nc"), (9003, f"x\ny\n{passage}")]
    frame = sample.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    pieces, seen = [], {}
    for i, t in sorted(texts_of(frame)):
        lines = t.split("\n")
        hashes = [signed(xxhash.xxh64_intdigest(x.encode(), 42)) for x in lines]
        ends = [k for k in range(len(lines)) if k == len(lines) - 1 or (k and signed(xxhash.xxh64_intdigest(hashes[k].to_bytes(8, "little", signed=True), xxhash.xxh64_intdigest(hashes[k - 1].to_bytes(8, "little", signed=True), 42))) % 3 == 0)]
        kept, lost, start = [], 0, 0
        for e in ends:
            piece = "\n".join(lines[start : e + 1])
            if e > start and piece.strip(" ") and piece in seen:
                lost += e + 1 - start
            else:
                kept.append(piece)
                if e > start:
                    seen.setdefault(piece, i)
            start = e + 1
        pieces.append((i, "\n".join(kept), len(lines), lost))
    got = [(r.doc_id, r.text, r.n_lines, r.n_removed_lines) for r in line_dedup.line_dedup(frame).collect()]
    equal(got, pieces)
    assert sum(r[3] for r in got if r[0] > 9000) > 0 and line_dedup.line_dedup(empty).count() == 0
    odd = line_dedup.line_dedup(docs)
    assert odd.count() == len(AWKWARD) and set(docs.columns) <= set(odd.columns) and odd.where("doc_id = 2").first()["text"] is None


def brute_windows(rows):
    seen, out = {}, []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):  # stable: rows that repeat an id stay in order
        if t is None:
            out.append((i, None, 1, 0))
            continue
        lines = t.split("\n")
        full = [k for k, x in enumerate(lines) if re.search(WORD, x)]
        lost = set()
        for k, (a, b) in enumerate(zip(full, full[1:])):
            first = seen.setdefault(tuple(lines[a : b + 1]), (len(out), k))
            if first not in ((len(out), k), (len(out), k - 1)):
                lost |= set(range(a, b + 1))
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in lost), len(lines), len(lost)))
    return out


def test_short_passages(spark, sample, docs, empty):
    more = []
    for n in (2, 3, 4, 5, 8):
        passage = [f"line {k} of the passage of {n}" for k in range(n)]
        more += [(9000 + 10 * n + d, "\n".join([f"before {n} {d}", *passage, f"after {n} {d}"])) for d in range(3)]
    more += [(9500, "one\n\ntwo\nx"), (9501, "y\none\n\ntwo\n"), (9502, "one\n\nelse"), (9503, "a\na\na"), (9504, "b\nb\nb\nb\nb"), (9505, "c\nd\nc\nd"), (9506, "")]
    frame = sample.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = {r.doc_id: (r.doc_id, r.text, r.n_lines, r.n_removed_lines) for r in line_dedup.line_dedup(frame, windows=True).collect()}
    equal(got.values(), brute_windows(texts_of(frame)))
    for n in (2, 3, 4, 5, 8):
        assert [got[9000 + 10 * n + d][3] for d in range(3)] == [0, n, n]
    assert got[9501][1] == "y\n" and got[9502][3] == 0 and got[9503][3] == 0 and got[9504][1] == "b\nb" and got[9505][1] == "c\nd"
    every = lambda rows: {x for t in rows for x in t.split("\n")}
    assert every(r[1] for r in got.values()) >= every(t for _, t in texts_of(frame)) - {""}
    odd = line_dedup.line_dedup(docs, windows=True)
    assert odd.count() == len(AWKWARD) and odd.columns == [*docs.columns, "n_lines", "n_removed_lines"] and odd.where("doc_id = 2").first()["text"] is None
    assert line_dedup.line_dedup(empty, windows=True).count() == 0


def test_lines_of_repeated_ids(spark):
    passage, unique = "\n".join(f"p {k}" for k in range(12)), "\n".join(f"u {k}" for k in range(12))
    rows = [(1, passage), (5, passage), (5, unique), (5, None), (None, passage + "\nx"), (None, unique + "\ny"), ((1 << 60) + 1, unique), ((1 << 60) + 3, ""), (2, "q\n" + passage), (2, "q\n" + passage)]
    frame = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, n_lines string").coalesce(1)
    got = line_dedup.line_dedup(frame, windows=True)
    assert got.columns == ["doc_id", "text", "n_lines", "n_removed_lines"]
    equal([tuple(r) for r in got.collect()], brute_windows(rows))
    texts = [r.text for r in line_dedup.line_dedup(frame).where("doc_id = 5").collect()]
    assert unique in texts and None in texts


# 8: copies


def brute_copies(rows):
    normal = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    groups = collections.defaultdict(list)
    for i, t in normal:
        groups[t].append(i)
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    return [(i, least(groups[t]), len(groups[t]), i == least(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in normal]


def test_copies(spark, sample, docs, empty):
    for frame in (sample, docs):
        equal([tuple(r) for r in exact_dedup.exact_dedup(frame).collect()], brute_copies(texts_of(frame)))
    assert exact_dedup.exact_dedup(empty).count() == 0
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {None, 1, 4, 7} and kept.where("doc_id in (2, 5)").count() == 0


def test_copies_of_far_ids(spark):
    rows = far_ids("a b", "a  b", "c")
    for kind, make in (("long", lambda i: i), ("string", lambda i: None if i is None else f"x{i}")):
        frame = spark.createDataFrame([(make(i), t, "clash") for i, t in rows], f"doc_id {kind}, text string, _row string").repartition(3)
        equal([r[:3] + r[4:] for r in map(tuple, exact_dedup.exact_dedup(frame).collect())], [r[:3] + r[4:] for r in brute_copies([(make(i), t) for i, t in rows])])
        kept = exact_dedup.keep_first(frame)
        assert kept.columns == frame.columns
        equal([(r.doc_id, r.text) for r in kept.collect() if r.text], [(make(rows[0][0]), "a b"), (make(rows[3][0]), "c")])
    same = spark.createDataFrame([(None, "z")] * 40 + [(3, "y")] * 40 + [(1, "copy"), (5, "copy"), (5, "unique")], "doc_id long, text string").repartition(5)
    equal([tuple(r) for r in exact_dedup.keep_first(same).collect()], [(None, "z"), (3, "y"), (1, "copy"), (5, "unique")])
    assert exact_dedup.keep_first(same.limit(0)).count() == 0


# 9: chats


def test_chats(spark):
    a = [("user", "hi"), ("assistant", "hello"), ("user", "more")]
    logs = {1: a[:1], 2: a[:2], 3: a, 4: a, 5: [("user", "hi"), ("assistant", "other")], 6: [("user", None)], 7: [(None, "hi")], None: [("user", "lost")]}
    rows = [(c, k, r, t, "x", "x") for c, said in logs.items() for k, (r, t) in enumerate(said)]
    rows += [(3, 0, "user", "hi", "x", "x")] + [(8, k, "user", f"t{k}", "x", "x") for k in range(1500)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string, _pos string")
    got = chat_format.chat_format(frame).collect()
    assert {r.conv_id for r in got} == {3, 5, 6, 7, 8, None}
    assert [r.text for r in got if r.conv_id == 3] == ["<|user|>\nhi<|end|>\n<|assistant|>\nhello<|end|>\n<|user|>\nmore<|end|>\n"]
    assert sorted((r.part, r.n_turns) for r in got if r.conv_id == 8) == [(0, 512), (1, 512), (2, 476)]
    assert "".join(r.text for r in sorted((r for r in got if r.conv_id == 8), key=lambda r: r.part)) == "".join(f"<|user|>\nt{k}<|end|>\n" for k in range(1500))
    assert chat_format.chat_format(frame.limit(0)).count() == 0


def brute_chats(rows, most=512):
    none_first = lambda x: tuple((v is not None, v) for v in x)
    logs = collections.defaultdict(set)
    for c, *said in rows:
        logs[c].add(tuple(said))
    logs = {c: [(r, t) for _, r, t in sorted(said, key=none_first)] for c, said in logs.items()}
    out = []
    for c, said in logs.items():
        rivals = [(d, other) for d, other in logs.items() if d != c and other[: len(said)] == said]
        if not any(len(other) > len(said) or (d is not None and (c is None or d < c)) for d, other in rivals):
            for k in range(0, len(said), most):
                part = said[k : k + most]
                out.append((c, k // most, len(part), "".join(f"<|{r or 'unknown'}|>\n{t or ''}<|end|>\n" for r, t in part)))
    return out


def test_chats_by_brute_force(spark):
    import duckdb

    from strataloom.llm.queries import ORACLE_SQL

    r = np.random.default_rng(5)
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (2, 0, "user", "a"), (3, 0, "user", "b"), (4, None, "user", "a"), (4, None, "user", "z"), (5, 7, None, "a"), (6, 7, None, None)]
    for c in range(10, 60):  # snapshots of few conversations, with ties in turn and role
        seed, n = int(r.integers(0, 6)), int(r.integers(1, 12))
        rows += [(c, k // 2, "user" if k % 3 else "assistant", f"t{seed if k > 2 else 0}{(k * 7) % 5}") for k in range(n)]
    rows += [(90, k, "user", f"long {k}") for k in range(1100)] + [(91, k, "user", f"long {k}") for k in range(700)]
    kind = "conv_id long, turn long, role string, text string"
    frame = spark.createDataFrame(rows, kind).repartition(3)
    got = [tuple(x) for x in chat_format.chat_format(frame).collect()]
    equal(got, brute_chats(rows))
    duckdb.sql("CREATE OR REPLACE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    duckdb.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    equal(got, duckdb.sql(ORACLE_SQL["op9_chat_format"]).select("conv_id, part, n_turns, text").fetchall())
    whole = chat_format.chat_format(frame.where("conv_id >= 90"), part_turns=None).collect()
    assert [(x.conv_id, x.part, x.n_turns) for x in whole] == [(90, 0, 1100)]
    hot = [(None, None, "user", f"x{k % 700}") for k in range(2000)] + [(None, 1, "user", "y"), (7, 0, "user", None)]
    frame = spark.createDataFrame(hot, kind).repartition(3)
    equal([tuple(x) for x in chat_format.chat_format(frame).collect()], brute_chats(hot))


# 10: packing


def check_packing(frame, rows):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and 0 < length <= 2048
            end += length
        assert end <= 2048
    found = collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want = collections.Counter()
    for i, t in texts_of(frame):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) - 2048 * ((len(ids) - 1) // 2048), len(ids) + 1, 2048)]
        want.update((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert found == want
    return len(by)


def test_packing(spark, sample, docs, empty):
    for frame in (sample, docs):
        rows = packing.best_fit_packing(frame, tokenizer_path("byte_bpe_50k.json")).collect()
        used = check_packing(frame, rows)
        assert used <= np.ceil(sum(r.length for r in rows) / 2048) * 1.02 + 1
    assert packing.best_fit_packing(empty, tokenizer_path("byte_bpe_50k.json")).count() == 0
    ids = packing.best_fit_packing(docs, tokenizer_path("byte_bpe_50k.json"), with_ids=True).collect()
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in ids)


def test_contract_ids(spark):
    from tokenizers import Tokenizer

    plain, cache = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), packing.ChunkCache(tokenizer_path("byte_bpe_50k.json"))
    for text in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>.\n\n y", "<|endoftext", "a  <|endoftext|>  b", "\u00a0. a\t\n", "it's  1,000.5!\r\n"):
        assert np.frombuffer(cache.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    same = spark.createDataFrame([(None, None)] * 3000 + [(1, "a b")] * 3000, "doc_id long, text string").repartition(4)
    pieces = packing.token_pieces(same, tokenizer_path("byte_bpe_50k.json"))
    groups = packing.pack(pieces, 6000, group_pieces=500).groupBy(F.shiftright("sequence_id", 32)).count().collect()
    assert len(groups) == 12 and max(r["count"] for r in groups) < 800


def test_placement_by_brute_force():
    r = np.random.default_rng(3)
    lengths = r.integers(1, 41, 120)
    bins, offsets = packing.pack_lengths(lengths, 40)
    gaps, where = {}, {}
    for k in np.argsort(-lengths, kind="stable"):
        size, count = int(lengths[k]), collections.Counter(g for g in gaps.values() if 0 < g)
        options = []
        for g in sorted({g for g in gaps.values() if g >= size} | {40}):
            after = count.copy()
            if g < 40:
                after[g] -= 1
            if g > size:
                after[g - size] += 1
            options.append((sum(v * v for v in after.values()), g))
        cost, g = min(options)
        after_gap = 40 - int(offsets[k])
        assert after_gap == g or any(c == cost and x == after_gap for c, x in options)
        gaps[int(bins[k])] = after_gap - size
        where[k] = after_gap


# all


def test_registered(spark):
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES) == list(range(1, 11))


# later findings


def test_one_paragraph_pages():
    text = "One long paragraph, with enough words; and marks to count as text. " * 3
    for page in (f"<div id=x><h1>Head line</h1><p>{text}</p></div>", f"<div id=x><h1>Head line</h1><div><p>{text}</p></div></div>", f"<body><a>Home</a><div id=x><h2>Head line</h2><p>{text}</div><p>Copyright</body>"):
        assert html_extraction.main_text(page).startswith("Head line\nOne long"), page


@pytest.mark.parametrize("step", ["<div>", "<div>a, b. ", "<article>a, b. ", "<ul><li>a", "<b><div class=ad>x"])
def test_deep_pages(step):
    """Work follows the length of the page at any depth."""
    import time

    began = time.process_time()
    html_extraction.main_text(step * 40_000 + "</p></section>" * 40_000)
    assert time.process_time() - began < 20


def test_packing_keeps_far_ids(spark):
    rows = [((1 << 60) + 1, "a b"), ((1 << 60) + 3, "c"), (None, "d e f"), (-(1 << 62) - 1, None)]
    got = packing.best_fit_packing(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path("byte_bpe_50k.json"))
    equal([(r.doc_id,) for r in got.collect()], [(i,) for i, _ in rows])


def test_quality_clashing_names(spark):
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    names = ["_n", "_words", "_hw", "_lines", "_tri", "_order", "_doc", "_text", "kept", "n_words", "a.b"]
    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType())] + [StructField(c, StringType()) for c in names])
    docs = spark.createDataFrame([(k, prose(k, 200), *[f"{c}{k}" for c in names]) for k in range(6)], schema)
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    out = quality_rules.quality_rules(docs, labels)
    assert {"_n", "_doc", "_text", "a.b"} <= set(out.columns) and {r["_n"] for r in out.collect()} == {f"_n{k}" for k in range(6)} and dict(out.dtypes)["kept"] == "boolean"
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and all(r["kept"] == f"kept{r.doc_id}" and r["n_words"] == f"n_words{r.doc_id}" for r in kept.collect())


def test_failed_calls_leave_nothing(spark, monkeypatch):
    import os

    from strataloom.llm import common

    folder = common.shared_folder(spark)
    before = set(os.listdir(folder.removeprefix("file:")))
    monkeypatch.setattr(exact_dedup, "without", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        exact_dedup.keep_first(spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string"))
    left = [d for d in set(os.listdir(folder.removeprefix("file:"))) - before if os.listdir(f"{folder.removeprefix('file:')}/{d}")]
    assert not left
