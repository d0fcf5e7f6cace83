"""Operators on small fixtures against plain versions: nulls, empty and long texts, ties, repeats, clashing columns, empty tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import exact, html_text, licenses, minhash, packing, pitman_yor, quality, sentencepiece_codec, toxicity, vector_lists, words
from plumbline.llm.components import components

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
LOREM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"
LONG = " ".join(f"w{i * i % 7919} {LOREM}." for i in range(600))
TEXTS = [None, "", "  \t\n ", "one", "one two", "One TWO", "one two three four five six seven", "one  two\tthree four five six seven ", LOREM, LOREM + " end",
         LOREM + " end", "Ünïcode «ñ» 漢字 and ▁ marks   x", LONG, LONG + " tail", "Released under the MIT License. See mit license!", "<|endoftext|> it's 12 3,4"]
SCHEMA = "doc_id long, text string, salt long, bucket long, rank long, score double, label string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, 2, 3, 0.5, "x") for i, t in enumerate(TEXTS)] + [(None, LOREM, 1, 2, 3, 0.5, "x"), (None, None, 1, 2, 3, 0.5, "x"), (8, LOREM, 1, 2, 3, 0.5, "x")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_docs():
    return list(enumerate(TEXTS)) + [(None, LOREM), (None, None), (8, LOREM)]


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# ---- words ----

@pytest.mark.parametrize("run", [16, 1 << 20])
def test_words_equal_a_plain_split(run):
    found = {}
    for w in words.words(pa.array(TEXTS), words.SPACED, (2,), run=run):
        for r, h, s, e, p in zip(w.row, w.hash, w.start, w.end, w.prefix[0]):
            found.setdefault(w.first + r, []).append((h, s, e, p))
    same, heads = {}, {}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        want = raw.lower().split()
        got = found.get(i, [])
        assert [raw[s:e].lower() for _, s, e, _ in got] == want
        for word, (h, _, _, p) in zip(want, got):
            assert same.setdefault(word, h) == h
            assert heads.setdefault(word[:2], p) == p
    assert len(set(same.values())) == len(same)


def test_shingles_are_distinct_and_short_rows_have_one():
    for w in words.words(pa.array(["a b", "a b c a b c", "", "a b c"])):
        sets, at = words.shingles(w, 3)
    assert np.diff(at).tolist() == [1, 3, 0, 1]
    assert sets[at[3]] in sets[at[1]:at[2]]


def test_components_of_a_chain_a_star_and_a_loop(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (300, 300), (None, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(2, 31)}, **{i: 100 for i in range(101, 140)}, 201: 200, 202: 200}


# ---- 1 ----

def test_pieces_are_the_best_segmentation_and_round_trip(spark, docs, nothing):
    codec = sentencepiece_codec.load(PIECES)
    assert codec.by_word
    for text in ("▁one", "▁▁▁the", "▁Ünï\n漢字", "▁" + "ab" * 20):
        best = [0.0] + [-math.inf] * len(text)
        for end in range(1, len(text) + 1):
            best[end] = best[end - 1] + codec.unknown
            for start in range(end):
                i = codec.pieces.get(text[start:end])
                if i is not None:
                    best[end] = max(best[end], best[start] + codec.scores[i])
        ids, score = codec.solve(text)
        assert score == pytest.approx(best[-1])
        assert b"".join(codec.spelled[i] for i in ids).decode() == text.replace("▁", " ")
    rows = sentencepiece_codec.encoded(docs, PIECES)
    out = rows.collect()
    assert len(out) == len(plain_docs()) and all(r["exact"] for r in out)
    assert {len(r["ids"]) == r["n_pieces"] for r in out} == {True}
    back = {(r["doc_id"], r["text"]) for r in sentencepiece_codec.decoded(rows, PIECES).select("doc_id", "text").collect()}
    assert back == {(i, t or "") for i, t in plain_docs()}
    assert sentencepiece_codec.encoded(nothing, PIECES).count() == 0


# ---- 2 ----

def test_neighbours_on_odd_vectors(spark):
    rng = np.random.default_rng(1)
    good = [(i, rng.normal(size=4).tolist(), 1) for i in range(40)] + [(40 + i, [1.0, 0.0, 0.0, 0.0], 1) for i in range(30)]
    bad = [(100, None, 1), (120, [0.0] * 4, 1), (140, [1.0, None, 0.0, 0.0], 1), (160, [float("nan"), 0.0, 0.0, 1.0], 1), (180, [float("inf"), 0.0, 0.0, 1.0], 1), (200, [1.0], 1), (220, [], 1), (None, [1.0] * 4, 1), (40, [1.0, 0.0, 0.0, 0.0], 1)]
    table = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>, list long")
    got = collections.defaultdict(list)
    for r in vector_lists.nearest_neighbours(table).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    x = {i: np.array(v) for i, v, _ in good}
    assert set(got) == {0, 20, 40, 60}
    for q, found in got.items():
        want = sorted(((-float(x[q] @ x[i]), i) for i in x if i != q))[:20]
        assert [i for i, _ in found] == [i for _, i in want]
        assert np.allclose([s for _, s in found], [-s for s, _ in want], rtol=0, atol=1e-12)
    assert vector_lists.nearest_neighbours(table.limit(0)).count() == 0


def test_neighbours_recall_with_many_lists(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16)) + rng.normal(size=(12, 16))[rng.integers(0, 12, 3000)] * 2
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    x = np.float32(x).astype(float)
    found = collections.defaultdict(set)
    for r in vector_lists.nearest_neighbours(table).collect():
        found[r["query_id"]].add(r["vec_id"])
    hits = 0
    for q in range(0, 3000, 20):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(found[q] & set(np.argsort(-score)[:20]))
    assert hits / (150 * 20) >= 0.9


def test_the_ratio_alone_chooses_lists():
    rng = np.random.default_rng(3)
    graph = vector_lists.CentroidGraph.build(np.float32(rng.normal(size=(1500, 64))))
    x = np.float32(rng.normal(size=(5, 64)))
    for mine, q in zip(vector_lists.probed_lists(graph, x, ratio=1.6), x):
        d = ((graph.centroids.astype(float) - q) ** 2).sum(1)
        assert len(mine) > 1024 and set(np.flatnonzero(d <= 1.599 ** 2 * d.min())) <= set(mine) <= set(np.flatnonzero(d <= 1.601 ** 2 * d.min()))


def test_neighbours_recall_with_lists_left_out(spark):
    rng = np.random.default_rng(8)
    x = np.float32(rng.normal(size=(10_000, 24)) + 2 * rng.normal(size=(40, 24))[rng.integers(0, 40, 10_000)]).astype(float)
    ids = np.arange(len(x))
    rows = spark.createDataFrame(list(zip(ids.tolist(), x.tolist())), "vec_id long, embedding array<double>").repartition(4)
    found = collections.defaultdict(set)
    for r in vector_lists.nearest_neighbours(rows).collect():
        found[r["query_id"]].add(r["vec_id"])
    hits = n = 0
    for i in np.flatnonzero(ids % 20 == 0):
        score = x @ x[i]
        score[i] = -np.inf
        hits, n = hits + len(found[ids[i]] & set(ids[np.argsort(-score)[:20]])), n + 20
    wide = np.concatenate([x, np.sqrt(np.maximum((x ** 2).sum(1).max() - (x ** 2).sum(1, keepdims=True), 0))], 1).astype(np.float32)
    graph = vector_lists.CentroidGraph.build(vector_lists.balanced_centroids(wide, -(-len(x) // (len(x) // vector_lists.LIST_ROWS))))
    wide[:, -1] = 0
    share = [len(p) / len(graph.centroids) for p in vector_lists.probed_lists(graph, wide[ids % 20 == 0])]
    assert len(graph.centroids) >= 3 * vector_lists.LEAST_LISTS and np.mean(share) < 0.8
    assert hits / n >= 0.9


def test_queries_meet_blocks_in_bounded_groups(spark, monkeypatch):
    rng = np.random.default_rng(4)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(2400, 8)))], "vec_id long, embedding array<double>")
    want = [tuple(r) for r in vector_lists.nearest_neighbours(table, every=2).orderBy("query_id", "rank").collect()]
    groups, search = spark.sparkContext.accumulator(0), vector_lists._searched

    def watched(k):
        inner = search(k)

        def run(stored, asked):
            assert stored.num_rows <= 1000 and asked.num_rows <= 400 and len(set(asked.column("vec_id").to_pylist())) == asked.num_rows
            groups.add(1)
            return inner(stored, asked)
        return run
    monkeypatch.setattr(vector_lists, "_searched", watched)
    monkeypatch.setattr(vector_lists, "QUERY_ROWS", 250)
    monkeypatch.setattr(vector_lists, "BUCKET_ROWS", 500)
    got = [tuple(r) for r in vector_lists.nearest_neighbours(table, every=2).orderBy("query_id", "rank").collect()]
    assert groups.value > 20 and [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], rtol=0, atol=1e-12)


# ---- 3, 5 ----

def corpus(spark, n=900):
    rng, rows, marks = np.random.default_rng(5), [], []
    plain = [f"word{i}" for i in range(200)]
    for i in range(n):
        sentences = [" ".join(rng.choice(plain, 8)) for _ in range(int(rng.integers(2, 9)))]
        toxic, junk = i % 5 == 0, i % 7 == 0
        if toxic:
            at = int(rng.integers(0, len(sentences)))
            sentences[at] += f" vile{rng.choice(['x', 'yy', 'zzz'])}"
        text = ". ".join(sentences) + "."
        rows.append((i, (text.upper().replace(" ", "!! ") if junk else text)))
        marks.append((i, int(not junk), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4), labels_of(spark, marks[: n * 4 // 5]), {m[0]: m for m in marks}


def test_toxicity_learns_from_few_labels_and_leaves_contradictions_out(spark):
    rows = [(i, f"{LOREM} w{i}. {'You are vermin and should rot' if i % 8 == 0 else 'Nice to see you'} n{i * 7 % 31}. {LOREM}") for i in range(87)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = [(i, 1, int(i % 8 == 0)) for i in range(87)]
    model = toxicity.fit(docs, labels_of(spark, marks))
    assert len(model.keys) > 0
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity_scores(docs, labels_of(spark, marks)).collect()}
    assert got == {i: t for i, _, t in marks}
    twisted = marks + [(i, 1, 1 - t) for i, _, t in marks]
    assert len(toxicity.fit(docs, labels_of(spark, twisted)).keys) == 0
    a, b = (sorted(map(tuple, toxicity.toxicity_scores(docs, labels_of(spark, m)).select("doc_id", "predicted").collect())) for m in (
        marks + [(8, 1, 0)], [(8, 1, 0)] + marks[::-1]))
    assert a == b


def test_quality_and_toxicity_generalise(spark):
    docs, labels, truth = corpus(spark)
    for make, column, folds, held in ((quality.quality_scores, 1, 5, 0), (toxicity.toxicity_scores, 2, 3, 1)):
        rows = make(docs, labels).collect()
        assert len(rows) == 900
        outside = [r for r in rows if r["held_out"]]
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == held) for r in rows)
        assert sum(r["predicted"] == truth[r["doc_id"]][column] for r in outside) / len(outside) > 0.98
        assert all(0 <= r["score"] <= 1 for r in rows)
    model = toxicity.fit(docs, labels)
    spans = toxicity.offending(docs, model).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert spans and all("vile" in s["words"].lower() for s in spans)
    assert all(texts[s["doc_id"]].encode()[s["start"]:s["end"]].decode() == s["words"] for s in spans)


def test_scores_of_odd_rows_and_missing_labels(spark, docs, nothing):
    one_kind = labels_of(spark, [(i, 1, 0) for i in range(12)] + [(None, 0, 1), (3, None, None)])
    for make, flat in ((quality.quality_scores, 1.0), (toxicity.toxicity_scores, 0.0)):
        rows = make(docs, one_kind).collect()
        assert len(rows) == len(plain_docs()) and {round(r["score"], 6) for r in rows} == {flat}
        assert make(nothing, one_kind).count() == 0
        rows = make(docs, one_kind.limit(0)).collect()
        assert len({r["score"] for r in rows}) == 1
    mixed = labels_of(spark, [(i, i % 2, i % 2) for i in range(16)])
    for make in (quality.quality_scores, toxicity.toxicity_scores):
        rows = make(docs, mixed).collect()
        assert len(rows) == len(plain_docs()) and all(r["score"] is not None and 0 <= r["score"] <= 1 for r in rows)


def test_isotonic_rates():
    assert quality.pool_adjacent(np.array([1, 1, 2, 1]), np.array([0, 1, 0, 1])).tolist() == [0, 1 / 3, 1 / 3, 1]
    assert len(quality.pool_adjacent(np.array([]), np.array([]))) == 0


def test_noisy_or_finds_the_guilty_feature():
    y = np.array([1, 0] * 50, float)
    doc = np.arange(100)
    theta, bias = toxicity.train_noisy_or(y, np.full(100, 3), doc, np.zeros(100, np.int64), (y < 0.5).astype(np.int64), 2)
    p = lambda z: 1 - np.exp(-np.logaddexp(0, z) - 2 * np.logaddexp(0, bias))
    assert p(bias + theta[0]) > 0.9 and p(bias + theta[1]) < 0.1


# ---- 4 ----

PAGE = """<html><head><title>no</title><style>p{}</style></head><body><header>no</header><nav><ul><li>no</ul></nav><div class="cookie-notice">no</div>
<article><header><h1>Head &amp; line</h1></header><p>one <b>two<br><p>three&nbsp; four</p><!-- no --><script>var t="</p>";</script><form>no</form>
<div id="comments"><p>no</p></div><table><tr><td>a<td>b</table>last</article><aside>no</aside><footer>no</footer></body></html>"""


def test_main_text_rules():
    assert html_text.main_text(PAGE) == "Head & line\none two\nthree four\na\nb\nlast"
    assert html_text.main_text("<div>x <i>y</i></div>z &lt;b&gt; <br> w") == "x y\nz <b>\nw"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p>  </p><script>no") == ""
    assert html_text.main_text("a < b and <p class='unclosed>c") == "a < b and <p class='unclosed>c"


@pytest.mark.parametrize("before", ["<script>for(i=0;i<n;i++){f(i)}</script>", "<script>document.write('<!--')</script>", "<style>a<b{}</STYLE >", "<title>a<b</title>", "<svg><path d='x<y'/></svg>",
                                    f'<img src="data:image/png;base64,{"A" * 9000}>">', f"<div data-state='{'[1,2],' * 3000}'></div>"])
def test_raw_elements_end_at_their_tag_and_long_values_are_values(before):
    assert html_text.main_text(f"{before}<article>Story</article>") == "Story"
    assert html_text.main_text(f"<article>Story{before}</article>") == "Story"


def test_site_templates_go_and_copies_stay(spark):
    page = lambda i, extra="": f"<body><div><p>Join our list today</p></div><div><p>Story {i} {extra}</p></div></body>"
    rows = [(i, "http://Site.example:80/a", page(i), 7) for i in range(9)] + [(20 + i, "https://copies.example/x", page("same"), 7) for i in range(6)]
    rows += [(40, None, page(40), 7), (41, "nonsense", page(41), 7), (42, "http://lone.example/", page(42), 7), (None, "http://site.example/b", page(9), 7), (43, "http://site.example/", None, 7), (0, "http://Site.example:80/a", page(0), 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host long")
    got = [tuple(r) for r in html_text.extracted(pages).select("page_id", "text", "n_chars").collect()]
    assert len(got) == len(rows) and all(n == len(t) for _, t, n in got)
    text = {i: t for i, t, _ in got}
    assert text[3] == "Story 3" and text[None] == "Story 9" and text[43] == ""
    assert text[20] == "Join our list today\nStory same" and text[41] == "Join our list today\nStory 41"
    assert html_text.extracted(pages.limit(0)).count() == 0


def test_quotes_comments_and_names():
    assert html_text.main_text("<article><p data-x=it's>Text don't stop</p><p>Two</p></article>") == "Text don't stop\nTwo"
    assert html_text.main_text('<p class="a"b">X</p>') == "X"
    assert html_text.main_text('<article><p>Main</p></article><article class="comment"><p>me too</p></article>') == "Main"
    assert html_text.main_text('<div class="share-price">Up 3</div><div class="share-buttons">no</div><div id="social-security">Law</div><p class="ad">no</p>') == "Up 3\nLaw"
    story = "A long story. " * 20
    assert html_text.main_text(f"<div>{story}</div><article>Teaser</article>") == f"{story.strip()}\nTeaser"
    assert html_text.main_text(f"<div>Teaser</div><article>{story}</article>") == story.strip()


def plain_texts(rows):
    """Texts by counting subtrees in plain loops, and what became of the blocks."""
    host = lambda url: m.group(1).lower() if (m := re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")) else ""
    once = collections.defaultdict(dict)
    for url, page in rows:
        found = html_text.blocks(page or "")
        sets = tuple(sorted({x for _, _, i, chain in found if i == inside for x in chain}) for inside in (False, True))
        content = html_text.main_text(page)
        once[host(url)][content] = min(sets, once[host(url)].get(content, sets))
    texts, fates = [], collections.Counter()
    for url, page in rows:
        seen = list(once[host(url)].values()) if host(url) else []
        drops = []
        for k, (least, share) in enumerate((html_text.OUTSIDE, html_text.INSIDE)):
            n = collections.Counter(x for sets in seen for x in sets[k])
            drops.append(frozenset(x for x, c in n.items() if c >= max(least, share * len(seen))))
        texts.append(html_text.main_text(page, *drops))
        fates.update(fate for _, fate in html_text.judged(page, *drops))
    return texts, fates


def test_templates_are_counted_outside_the_article_too(spark):
    menu = "<nav><ul><li>Home</li><li>News</li></ul></nav>"
    rows = [(i, "http://a.example/", f"<body>{menu}<div><p>Join us</p></div><article><p>Own {i}</p><ul><li>Home</li></ul><div><p>By us</p></div></article><footer>f {i}</footer></body>") for i in range(12)]
    rows += [(100 + i, "http://b.example/", f"<body>{menu}<article><p>Own {i}</p><div><p>By us</p></div></article></body>") for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    text = {r["page_id"]: r["text"] for r in html_text.extracted(pages).collect()}
    # A list line of the menu is no template of the article's own list unless it recurs there too, as here on a.example.
    assert text[3] == "Own 3" and text[103] == "Own 3\nBy us"
    want, fates = plain_texts([r[1:] for r in rows])
    assert [text[r[0]] for r in rows] == want
    assert {r["fate"]: r["blocks"] for r in html_text.removed(pages).collect()} == dict(fates)
    assert fates["template"] == 12 * 5 + 5 * 2 and fates["tag"] == 12


def test_pages_equal_the_plain_count(spark):
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    want, fates = plain_texts([r[1:] for r in rows])
    assert {r["page_id"]: r["text"] for r in html_text.extracted(pages).collect()} == dict(zip([r[0] for r in rows], want))
    assert {r["fate"]: r["blocks"] for r in html_text.removed(pages).collect()} == dict(fates)


# ---- 6 ----

def test_ids_equal_the_tokenizers_library():
    ours, theirs = packing.tokenizer(BPE), Tokenizer.from_file(BPE)
    theirs.encode_special_tokens = True
    for t in [t for t in TEXTS if t] + ["a  b", " a", "a ", "a\n b", "a \nb", "x  y", " a b", "don't  we'll\r\n\r\n  ok", "a\x1c b"]:
        assert np.frombuffer(ours(t), "<u4").tolist() == theirs.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("capacity", [32, 2048])
def test_packing_is_gapless_and_whole(spark, docs, nothing, capacity):
    rows = packing.packed(docs, BPE, capacity, groups=6).collect()
    encode = packing.tokenizer(BPE)
    want = collections.Counter()
    for i, t in plain_docs():
        ids = encode(t or "") + b"\0\0\0\0"
        n = len(ids) // 4
        cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(ids[4 * a:4 * b])] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    ends = collections.defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert ends[r["sequence_id"]] == r["offset"]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= capacity
    assert len(ends) <= -(-sum(ends.values()) // capacity) + 2
    whole = {r["sequence_id"]: r for r in packing.sequences(docs, BPE, capacity, groups=6).collect()}
    assert {r["length"] for r in whole.values()} == set(ends.values()) and len(whole) == len(ends)
    assert packing.packed(nothing, BPE).count() == 0


def test_configurations_place_most_long_pieces():
    encode = packing.tokenizer(BPE)
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    counts = collections.Counter()
    for t in texts:
        n = len(encode(t or "")) // 4 + 1
        counts[(n - 1) % 2048 + 1] += 1
        counts[2048] += (n - 1) // 2048
    for times in (1, 1000):
        many = {x: n * times for x, n in counts.items()}
        long_ones = sum(n for x, n in many.items() if 256 < x < 2048)
        runs, rooms, _ = packing.substituted(many)
        assert sum(n for x, _, n, _, _ in runs if x < 2048) > 0.75 * long_ones
        assert all(free <= 4 for free, _, _ in rooms)
        assert packing.make_plan(many)[1] <= 1.002 * -(-sum(x * n for x, n in many.items()) // 2048)
    assert packing.substituted({}) == ([], [], 0) and packing.substituted({2048: 3, 5: 2})[2] == 3


def test_plan_nears_the_lower_bound():
    rng = np.random.default_rng(3)
    for sizes in (rng.integers(1, 2049, 4000), np.minimum(rng.geometric(1 / 500, 5000), 2048), rng.integers(700, 1400, 3000), np.full(100, 1024)):
        counts = collections.Counter(int(x) for x in sizes)
        runs, n = packing.make_plan(counts, 2048, 32)
        placed = collections.Counter()
        for length, _, k, _, _ in runs:
            placed[length] += k
        assert placed == counts
        used = np.zeros(n, np.int64)
        for length, _, k, first, offset in runs:
            assert (offset + length <= 2048)
            used[first:first + k] += length
        assert used.max() <= 2048 and (used > 0).all()
        big = int((np.asarray(sizes) > 1024).sum())
        assert n <= max(-(-int(sum(sizes)) // 2048), big) * 1.08 + 2


# ---- 7 ----

@pytest.mark.parametrize("slots", [None, 3])
def test_exact_groups_with_and_without_hash_clashes(docs, nothing, slots):
    rows = exact.exact_groups(docs, least=4, most=16, slots=slots).collect()
    bare = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = collections.defaultdict(list)
    for i, t in plain_docs():
        groups[bare(t)].append((-len(t or ""), i is None, i))
    want = collections.Counter()
    for i, t in plain_docs():
        best = min(groups[bare(t)], key=lambda x: (x[0], x[1], x[2] or 0))[2]
        want[i, best, len(groups[bare(t)]), i == best, hashlib.sha256(bare(t).encode()).hexdigest()] += 1
    assert collections.Counter(tuple(r) for r in rows) == want
    assert exact.exact_groups(nothing).count() == 0


# ---- 8 ----

def test_license_base_places_and_suppression(spark, docs, nothing):
    texts = ["MIT license, mit-license; Apache License and the GNU General Public License", "Licensed under the Apache License, Version 2.0", "mitK license MIT\nLICENSE",
             "commit license", "SPDX-License-Identifier: GPL-3.0-or-later", "Released under the GNU Lesser General Public License v2.1", "mit license " * 300,
             "This work is licensed under CC BY-NC 4.0."]
    rows = spark.createDataFrame([(100 + i, t, 1, 1, 1, 1.0, "y") for i, t in enumerate(texts)], SCHEMA).unionByName(docs)
    got = collections.Counter()
    for r in licenses.license_scan(rows).collect():
        got[(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])] += 1
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    want = collections.Counter()
    for i, t in [(100 + i, t) for i, t in enumerate(texts)] + plain_docs():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER)))
        places = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(w)) if w[k:k + len(phrase.split())] == phrase.split()]
        at = [k for k, _ in places]
        want[i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))] += 1
    assert got == want
    labels = {r["doc_id"]: r["labels"] for r in licenses.license_scan(rows).collect()}
    assert labels[101] == "apache,apache-2.0" and labels[104] == "gpl-3.0-or-later" and labels[105] == "gpl,lgpl-2.1" and labels[107] == "cc-by-nc"
    assert licenses.license_scan(nothing).count() == 0


def test_every_rule_compiles_and_has_its_keyword():
    from plumbline.llm.license_rules import rules
    made = rules()
    assert len(made) > 200
    for _, label, _, confidence, keyword, pattern in made:
        re.compile(pattern)
        assert label and 0 < confidence < 1 and " " not in keyword


def instance_of(parsed, pick):
    """A text that a parsed pattern matches; ``pick`` chooses among n ways."""
    out = ""
    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            out += chr(value)
        elif name == "ANY":
            out += "x"
        elif name == "IN":
            low = [chr(v if str(o) == "LITERAL" else v[0]) for o, v in value]
            out += low[pick(len(low))]
        elif name == "BRANCH":
            out += instance_of(value[1][pick(len(value[1]))], pick)
        elif name == "SUBPATTERN":
            out += instance_of(value[3], pick)
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            least, most, inner = value
            out += "".join(instance_of(inner, pick) for _ in range(least + pick(min(int(most), least + 3) - least + 1)))
        else:
            assert name in ("ASSERT", "ASSERT_NOT")
    return out


def test_every_rule_finds_its_own_pattern_alone(spark):
    from re import _parser

    from plumbline.llm.license_rules import rules
    rng = np.random.default_rng(9)
    picks = [lambda n: 0, lambda n: n - 1] + [lambda n: int(rng.integers(0, n))] * 12
    rows, sure = [], set()
    for number, _, _, _, keyword, pattern in rules():
        for pick in picks:
            text = " ".join(instance_of(_parser.parse(pattern), pick).split())
            if re.search(pattern, f" {text} "):
                assert keyword in text.split(), (keyword, text)
                rows.append((number, text))
                sure.add(number)
    assert len(sure) == len(rules())
    phrases = {"BSD-3-Clause": "bsd-3-clause", "2-clause BSD": "bsd-2-clause", "Simplified BSD": "bsd-2-clause", "BSD zero clause": "bsd-0-clause", "MIT No Attribution": "mit-0", "WTFPL": "wtfpl",
               "same terms as Perl itself": "artistic-1.0", "proprietary and confidential": "proprietary", "Unauthorized copying of this file, via any medium is strictly prohibited": "proprietary",
               "Attribution-NonCommercial-ShareAlike 4.0 International": "cc-by-nc-sa", "Attribution-NonCommercial-NoDerivatives 4.0": "cc-by-nc-nd", "OpenRAIL-M": "openrail-m"}
    table = spark.createDataFrame([(i, t) for i, t in enumerate([t for _, t in rows] + list(phrases))], "doc_id long, text string").repartition(8)
    found = {r["doc_id"]: {d["rule"] for d in r["found"]} for r in licenses.scanned(table).select("doc_id", "found").collect()}
    assert [(n, t) for i, (n, t) in enumerate(rows) if n not in found[i]] == []
    labels = {r["doc_id"]: r["labels"].split(",") for r in licenses.license_scan(table.where(f"doc_id >= {len(rows)}")).collect()}
    assert [t for i, (t, label) in enumerate(phrases.items()) if label not in labels[len(rows) + i]] == []


def test_contained_detections_go(spark):
    found = "array<struct<rule: int, label: string, priority: int, confidence: double, start: int, end: int>>"
    rng = np.random.default_rng(4)
    sets = {k: [(i, f"l{i}", int(rng.integers(0, 5)), 0.5, int(s), int(s + rng.integers(1, 12))) for i, s in enumerate(rng.integers(0, 20, 9))] for k in range(30)}
    rows = spark.createDataFrame([(k, k, v) for k, v in sets.items()], f"key long, doc_id long, found {found}")
    got = {(r["key"], r["rule"]) for r in licenses.surviving(rows).collect()}
    want = set()
    for k, v in sets.items():
        order = sorted(v, key=lambda d: (d[4], -d[5], -d[2], d[0]))
        want |= {(k, d[0]) for n, d in enumerate(order) if not any(e[5] >= d[5] and e[2] >= d[2] for e in order[:n])}
    assert got == want


# ---- 9 ----

def plain_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        if i is not None:
            sets[i] = frozenset(tuple(w[j:j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_all_pairs(spark, docs, k, percent):
    rng = np.random.default_rng(6)
    base = [f"v{i}" for i in rng.integers(0, 500, 120)]
    rows = list(plain_docs())
    for i in range(120):  # copies around the threshold, from light to heavy edits
        mine = list(base)
        for at in rng.choice(120, i % 9, replace=False):
            mine[at] = f"e{rng.integers(0, 40)}"
        rows.append((1000 + i, " ".join(mine)))
    rows += [(2000 + i, " ".join(base[:60] + [f"u{i}_{j}" for j in range(20)])) for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = minhash.near_duplicates(table, k, percent).collect()
    want = plain_components(rows, k, percent)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])


def test_near_duplicates_of_nothing(nothing):
    assert minhash.near_duplicates(nothing).count() == 0


def test_blocks_link_across_components(spark):
    rng = np.random.default_rng(8)
    base = [f"v{i}" for i in range(150)]
    rows, shared = [], []
    for i in range(60):
        mine = list(base)
        mine[int(rng.integers(0, 150))] = f"e{i % 4}"
        rows.append((i, " ".join(mine)))
        shared.append((7, 0, 59, i, 148))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    roots = spark.createDataFrame([], "node long, root long")
    links = minhash.leftover_links(spark.createDataFrame(shared, "bucket long, low long, high long, doc_id long, n_shingles long"), roots, table, 3, 85)
    got = {r["node"]: r["root"] for r in components(links).collect()}
    want = plain_components(rows, 3, 85)
    assert {i: got.get(i, i) for i, _ in rows} == {i: w[1] for i, w in want.items()}


# ---- 10 ----

def test_base_scores_and_model_of_small_documents(docs, nothing):
    rows = pitman_yor.model_scores(docs).collect()
    counts, ends = collections.Counter(), 0
    train = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 != 0
    for i, t in plain_docs():
        if train(i):
            counts.update((t or "").encode().lower().split())
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    want = collections.Counter()
    for i, t in plain_docs():
        w = (t or "").encode().lower().split()
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w) + math.log10((ends + 0.1) / (n + 0.1 * (v + 1)))
        want[i, not train(i), len(w) + 1, sum(counts[x] > 0 for x in w) + 1, n, round(base, 6)] += 1
    assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows) == want
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in rows)
    assert pitman_yor.model_scores(nothing).count() == 0


def test_letters_are_a_distribution_and_tables_are_sane():
    spelled = [b"the", b"then", b"thin", b"a", "né".encode()]
    alphabet = np.full(pitman_yor.CODE_POINTS, pitman_yor.OTHER, np.uint8)
    for i, c in enumerate("thenia"):
        alphabet[ord(c)] = i
    context, symbol, _ = pitman_yor.coded(spelled, alphabet)
    code, n = np.unique(context * pitman_yor.SYMBOLS + symbol, return_counts=True)
    letters = pitman_yor.seat_letters(code, n.astype(np.int64), alphabet, np.random.default_rng(0))
    assert np.allclose((10.0 ** letters.table.astype(float)).sum(1), 1, atol=1e-4)
    assert letters.log10([b"the"])[0] > letters.log10([b"xqz"])[0]
    counts = np.array([1, 40, 10_000])
    last, mean = pitman_yor.expected_tables(counts, np.full(3, 0.9), 0.6, 60, np.random.default_rng(1))
    assert ((1 <= last) & (last <= counts)).all() and (np.diff(mean) >= 0).all() and mean[0] == 1


def test_seating_matches_the_exact_law():
    """Two customers of a dish share a table with probability (1 - d) / (1 - d + fresh)."""
    n, fresh, d = 4000, 0.7, 0.4
    _, mean = pitman_yor.expected_tables(np.full(n, 2), np.full(n, fresh), d, 40, np.random.default_rng(2))
    assert mean.mean() == pytest.approx(1 + fresh / (1 - d + fresh), abs=0.03)


def test_word_order_counts_in_the_model(spark):
    """The same words in the order of the training rows are likelier; contexts give each word but the rest of its probability."""
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    rows = [(i, "one two three four five six") for i in range(60) if i not in held] + [(held[0], "one two three four five six"), (held[1], "six four two five three one")]
    got = {r["doc_id"]: r for r in pitman_yor.model_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows) and got[held[0]]["held_out"] and got[held[1]]["held_out"]
    assert got[held[0]]["base_score"] == pytest.approx(got[held[1]]["base_score"])
    assert got[held[0]]["score"] > got[held[1]]["score"] + 2


def test_next_words_are_a_distribution(spark):
    """Held-out documents of one word each: what follows the start sums to less than 1, with the end and unknown words to about 1."""
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(40)]
    free = [i for i in range(5000) if zlib.crc32(str(i).encode()) % 10 == 0]
    train = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 10 != 0][:300]
    rows = [(i, " ".join(rng.choice(vocabulary, 12, p=np.arange(40, 0, -1) / 820))) for i in train]
    asked = dict(zip(free, vocabulary))
    # With a word after it that no training row has, the rest of the text costs the same after every word but for its context.
    rows += [(i, w) for i, w in asked.items()] + [(free[50], ""), (free[51], "w0")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    scored = {r["doc_id"]: 10 ** r["score"] for r in pitman_yor.model_scores(table).collect()}
    assert 0 < sum(scored[i] for i in asked) + scored[free[50]] < 1
    assert scored[free[51]] == pytest.approx(scored[free[0]], rel=1e-5)
