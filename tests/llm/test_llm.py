"""The ten operators and the pipeline against brute force, on small fixtures with nulls, blanks, ties and repeats."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm.common import tokenizer_file

SF = "/root/testdata/sf0.001"
BPE = tokenizer_file("byte_bpe_50k.json")
DOCS = "doc_id long, text string, row string, t string, c string, cls string"  # other columns clash with inner names


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", "y", "z", "w") for d, t in rows], DOCS).repartition(3)


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def corpus(seed=3, n=60):
    r = random.Random(seed)
    out = []
    for k in range(n):
        if out and r.random() < 0.5:
            w = r.choice(out)[1].split(" ")
            for _ in range(r.choice((0, 0, 1, 2, 6))):
                w[r.randrange(len(w))] = r.choice(WORDS) + str(r.randrange(50))
            t = " ".join(w)
        else:
            t = " ".join(r.choice(WORDS) + (str(r.randrange(40)) if r.random() < 0.5 else "") for _ in range(r.choice((1, 2, 5, 30, 80))))
        out.append((k, t))
    return [*out, (100, None), (101, ""), (102, "  \n "), (None, "alpha beta"), (103, "alpha beta"), (5, out[5][1]), (104, "é ü 日本 語 " * 40)]


def roots(n, links):
    p = list(range(n))

    def f(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in links:
        a, b = f(a), f(b)
        p[max(a, b)] = min(a, b)
    return [f(i) for i in range(n)]


def no_rows(df):
    assert df.count() == 0


# --- 1

def test_toxicity_held_out(spark):
    from corvane.llm.toxicity import toxicity

    r = random.Random(1)
    rows, labels = [], []
    for k in range(900):
        bad = k % 5 == 0
        w = [r.choice(WORDS) + str(r.randrange(20)) for _ in range(r.randrange(5, 60))]
        if bad:
            for _ in range(r.randrange(1, 5)):
                w.insert(r.randrange(len(w)), r.choice(("vileword", "nastyword", "crudeword")))
        rows.append((k, " ".join(w)))
        if k < 600:
            labels.append((k, int(bad), 1))
    lab = spark.createDataFrame([*labels, (None, 1, 1), (0, None, 1)], "doc_id long, toxic int, quality int")
    out = toxicity(frame(spark, [*rows, (9000, None), (9001, "")]), lab).collect()
    got = {x["doc_id"]: x for x in out}
    assert len(out) == 902 and not got[9000]["toxic"] and not got[9001]["toxic"]
    assert all(got[k]["toxic"] == (k % 5 == 0) for k in range(600, 900))
    sev = {n: np.mean([got[k]["expected_severity"] for k, t in rows if k % 5 == 0 and t.count("yword") + t.count("eword") == n]) for n in (1, 4)}
    assert sev[4] > sev[1] > 0.5
    no_rows(toxicity(frame(spark, []), lab))


def test_toxicity_odd_rows(spark):
    """Columns that clash with the result's, rows without an id, repeated labelled ids, a very long text."""
    from corvane.llm.toxicity import sample_features, score, toxicity, train

    rows = [(k, f"good words number {k}" if k % 5 else f"vileword crudeword {k}", "t", 5) for k in range(200)]
    rows += [(None, "vileword crudeword", "t", 5), (None, None, None, None), (3, "another text of it", "t", 5), (300, "plain " * 200_000 + "vileword crudeword", "t", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic string, Grade int").repartition(3)
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(150)], "doc_id long, toxic int")
    out = toxicity(df, labels, keep=["doc_id", "toxic", "Grade"])
    assert out.columns == ["doc_id", "docs_toxic", "docs_Grade", "expected_severity", "grade", "p_toxic", "toxic"]
    got = out.collect()
    assert len(got) == 204 and {r["docs_Grade"] for r in got} == {5, None} and [r["toxic"] for r in got if r["doc_id"] == 300] == [True]
    assert sorted(r["toxic"] for r in got if r["doc_id"] is None) == [False, True]
    assert all(r["toxic"] == (r["doc_id"] % 5 == 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 200)
    y, x = sample_features(df, labels, 12, 40, "doc_id", "text", "toxic")
    assert len(y) == len(x) == 40
    kept = score(df, train(df, labels), df.columns, prefix="own_").filter("not own_toxic").select(df.columns)
    assert kept.columns == df.columns and kept.count() == 162


def test_ordinal_thresholds_are_ordered():
    from corvane.llm.toxicity import fit

    r = np.random.default_rng(0)
    grade = r.integers(0, 4, 400)
    doc = np.repeat(np.arange(400), grade)
    feature = np.concatenate([np.arange(g) for g in grade])
    m = fit(doc, feature, grade, 3)
    assert (np.diff(m.cuts) > 0).all() and (np.argmax(m.grades(np.array([m.weights.sum()]))) >= 0)
    up = m.grades(np.bincount(doc, weights=m.weights[feature], minlength=400))
    assert (np.diff(up, axis=1) <= 0).all() and np.abs(up.sum(axis=1) - grade).mean() < 0.3


# --- 2

@pytest.mark.parametrize(("size", "hash_sql"), [(4096, "xxhash64({})"), (3, "xxhash64({})"), (4, "xxhash64({}) % 5")])
def test_exact_dedup(spark, size, hash_sql):
    from corvane.llm.exact_dedup import exact_dedup

    rows = [r for r in corpus(n=25)]
    out = exact_dedup(frame(spark, rows), size, hash_sql=hash_sql).collect()
    by = {}
    for d, t in rows:
        by.setdefault(t or "", []).append(d)
    want = sorted((d if d is not None else -1, max((x for x in by[t or ""] if x is not None), default=-1), len(by[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows)
    assert sorted((x["doc_id"] if x["doc_id"] is not None else -1, x["keep_id"] if x["keep_id"] is not None else -1, x["group_size"], x["text_sha256"]) for x in out) == want
    assert all(x["kept"] == (x["doc_id"] == x["keep_id"]) for x in out)


def test_exact_dedup_empty(spark):
    from corvane.llm.exact_dedup import exact_dedup

    no_rows(exact_dedup(frame(spark, [])))


# --- 3

def test_near_vectors(spark):
    from corvane.llm.collision import near_vectors

    r = np.random.default_rng(5)
    base = r.standard_normal((40, 16))
    rows = [(k, (base[k % 40] * (1 + k) + r.standard_normal(16) * r.choice([0, 0.1, 0.3]) * (1 + k)).tolist(), k % 3) for k in range(300)]
    rows += [(900, rows[0][1], 0), (901, None, 0), (902, [0.0] * 16, 0), (903, [float("nan")] + [1.0] * 15, 0), (904, rows[0][1], None), (905, [None, 1.0], 0), (906, [], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame([(a, b, c, 1, 2) for a, b, c in rows], "vec_id long, embedding array<double>, label int, n int, cell int")
    out = near_vectors(df, 0.98, block=16).collect()
    ok = [k for k, (_, v, l) in enumerate(rows) if l is not None and v and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = []
    for a, b in itertools.combinations(ok, 2):
        x, y = np.array(rows[a][1]), np.array(rows[b][1])
        if rows[a][2] == rows[b][2] and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
            links.append((a, b))
    n = np.bincount(np.array(links).ravel(), minlength=len(rows))
    root = roots(len(rows), links)
    comp = {}
    for k, g in enumerate(root):
        comp.setdefault(g, []).append(rows[k][0])
    low = lambda g: min((x for x in comp[g] if x is not None), default=-1)
    want = sorted((rows[k][0] if rows[k][0] is not None else -1, int(n[k]), low(root[k])) for k in range(len(rows)))
    got = sorted((x["vec_id"] if x["vec_id"] is not None else -1, x["n_links"], x["component_id"]) for x in out)
    assert len(links) > 100 and got == want
    far = spark.createDataFrame([(k, [s * x for x in (3.0, 4.0, k * 1e-3)], 1) for k, s in enumerate((1e200, 1e-200, 1.0, 1e300))], "vec_id long, embedding array<double>, label int")
    assert {r["component_id"] for r in near_vectors(far).collect()} == {0} and {r["n_links"] for r in near_vectors(far).collect()} == {3}
    no_rows(near_vectors(df.limit(0)))


# --- 4

@pytest.mark.parametrize("tile", [20_000, 3])
def test_line_dedup(spark, tile):
    from corvane.llm.line_dedup import drop_lines, removed_lines

    r = random.Random(2)
    lines = [t for _, t in corpus(7, 80) if t is not None]
    rows = [(k, "\n".join(r.choice(lines) for _ in range(r.randrange(1, 6)))) for k in range(40)] + [(50, None), (51, "\n\n"), (52, "Alpha  BETA"), (53, "beta alpha\n"), (None, "beta alpha\nnew line")]
    out = {x["doc_id"]: x for x in removed_lines(frame(spark, rows), tile=tile).collect()}
    seen = []
    for d, t in sorted(rows, key=lambda x: (x[0] is None, x[0])):
        want = []
        for i, line in enumerate((t or "").split("\n")):
            s = set(line.encode().lower().split())
            if s and any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                want.append(i)
            if s:
                seen.append(s)
        assert out[d]["removed"] == want and out[d]["n_lines"] == (t or "").count("\n") + 1 and out[d]["n_removed"] == len(want)
    no_rows(removed_lines(frame(spark, [])))
    one = frame(spark, [(1, "a b c"), (2, "x\na b c\ny")])
    assert {x["doc_id"]: x["text"] for x in drop_lines(one, removed_lines(one)).collect()} == {1: "a b c", 2: "x\ny"}


@pytest.mark.parametrize("most,tile", [(1, 20_000), (2, 9), (4, 20_000)])
def test_line_dedup_families(spark, most, tile):
    """Families of near-equal lines in which a line's likeliest pair often fails: open lists, equal hints, ids in any order."""
    from corvane.llm.line_dedup import removed_lines

    r = random.Random(most)
    families = [[f"w{f}x{i}" for i in range(12)] for f in range(4)]

    def near():
        line = [w for w in r.choice(families) if r.random() > 0.06] + [f"y{r.randrange(9)}" for _ in range(r.randrange(3))]
        r.shuffle(line)
        return " ".join(line)

    ids = r.sample(range(-50, 200), 60)
    rows = [(d, "\n".join(near() for _ in range(r.randrange(1, 7)))) for d in ids] + [(None, near()), (1 << 62, near() + "\n" + near())]
    out = {x["doc_id"]: x["removed"] for x in removed_lines(frame(spark, rows).repartition(5), tile=tile).collect()}
    seen = []
    for d, t in sorted(rows, key=lambda x: (x[0] is None, x[0])):
        want = []
        for i, line in enumerate(t.split("\n")):
            s = set(line.split())
            if any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                want.append(i)
            seen.append(s)
        assert out[d] == want


def thue_morse(n, a, b):
    return "".join((a, b)[bin(k).count("1") & 1] for k in range(n))


def test_structured_words(spark):
    """Long words that differ in structure only are different words: lines, shingle sets and word hashes."""
    from corvane.llm.line_dedup import removed_lines
    from corvane.llm.minhash import minhash_dedup
    from corvane.llm.words import buffers, bounds, hashes, SPACE
    import pyarrow as pa

    x, y = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    assert {r["doc_id"]: r["n_removed"] for r in removed_lines(frame(spark, [(1, x), (2, y), (3, x)])).collect()} == {1: 0, 2: 0, 3: 1}
    text = " ".join([x, y, x, y, y, x, x])
    out = minhash_dedup(frame(spark, [(1, text)]), k=3, num=85, den=100, bands=24, rows=6).collect()
    assert out[0]["n_shingles"] == 5
    words = [thue_morse(n, "a", "b") for n in range(1, 700)] + [thue_morse(n, "b", "a") for n in range(1, 700)] + ["A" * n for n in range(2, 30)]
    data, off = buffers(pa.array([" ".join(words)]))
    s, e = bounds(data, off, SPACE)
    assert len(set(hashes(data, s, e).tolist())) == len({w.lower() for w in words})
    assert (hashes(data, s, e) == np.concatenate([hashes(data, s[k : k + 1], e[k : k + 1]) for k in range(len(s))])).all()


def test_line_dedup_long_and_odd(spark):
    """A line of very many words, a word of very many letters, lines that end in white space, carriage returns."""
    from corvane.llm.line_dedup import removed_lines

    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, long), (2, long + " more"), (3, "z" * 100_000 + "\n" + "z" * 100_001), (4, "a b c d e \r"), (5, "\ta b c d e\n\n"), (6, "a b c d e f\v")]
    out = {r["doc_id"]: r["removed"] for r in removed_lines(frame(spark, rows)).collect()}
    assert out == {1: [], 2: [0], 3: [], 4: [], 5: [0], 6: [0]}


# --- 5

def test_html(spark):
    from corvane.llm.html_text import extract, main_text

    cases = {
        "<html><body><nav>m</nav><article><h1>T &amp; U</h1><p><b>a\n b<br><p>c&nbsp;d</article><footer>f</footer>": "T & U a b c d",
        '<body><div class="sidebar">s</div><p>one<p>two<script>var x="</p>"</script><aside>z</aside><!-- c -->': "one two",
        '<main><div id="comments">no</div><p>y<em>es</em></p><form>q</form></main><p>out</p>': "yes",
        '<article><p>x</p><article class="comment">no</article></article>': "x",
        "plain &lt;text&gt;": "plain <text>",
        "<article>open <div>never closed": "open never closed",
        "": "",
    }
    cases |= {
        '<body><div class="content has-sidebar"><article><p>a</p></article><div class="sidebar-left">s</div></div>': "a",
        '<body><div class="page-wrapper no-sidebar" id="social-history"><main>b</main></div>': "b",
        '<body><form id="aspnetForm"><div class="site-header">h</div><main>c</main></form>': "c",
        '<body><div class="banner"><article>d</article></div><aside><article>teaser</article></aside>': "d",
        '<body><div class="comment-list">x</div><div id="main-nav">y</div><div class="post ad-slot">z</div><p>e': "e",
        "<p>" + "long &amp; wide " * 50_000: " ".join(["long & wide"] * 50_000),
    }
    for page, want in cases.items():
        assert main_text(page) == want
    box = '<div><a href="/x">same</a></div>'
    pages = [(k, f"http://h.example/{k}", f"<body>{box}<p>own {k}</p></body>") for k in range(12)] + [(20, None, None), (21, "u", ""), (22, "http://o.example/", f"<body>{box}</body>")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, host string")
    for limit in (1 << 20, 0):
        got = {x["page_id"]: x for x in extract(df, broadcast_bytes=limit).collect()}
        assert [got[k]["text"] for k in range(12)] == [f"own {k}" for k in range(12)]
        assert got[20]["text"] == got[21]["text"] == "" and got[22]["text"] == "same" and got[22]["n_chars"] == 4
    no_rows(extract(df.limit(0)))


def test_html_keeps_the_text_of_copies(spark):
    """Copies of a page on a host, and pages that share most of their main text, keep it; a shared box still goes."""
    from corvane.llm.html_text import extract

    box, items = '<div><a href="/x">same</a></div>', "<ul><li>one</li><li>two</li></ul>"
    copied = f'<article><div class="body"><p>first words of it</p>{items}<p>last words of it</p></div></article>'
    plain = f"<body><div><div>a body of divs</div>{items}</div><div>end of it</div></body>"
    mirror = "<article><div class='text'><p>the same long text in all of them</p></div><p>no {}</p></article>"
    pages = [copied] * 6 + [plain] * 6 + [f"<title>{k}</title>{copied}" for k in range(6)] + [mirror.format(k) for k in range(6)]
    pages += [f"<body>{box}<p>own page {k}</p></body>" for k in range(6)]
    df = spark.createDataFrame([(k, f"http://h.example/{k}", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    got = {x["page_id"]: x["text"] for x in extract(df).collect()}
    article = "first words of it one two last words of it"
    want = [article] * 6 + ["a body of divs one two end of it"] * 6 + [article] * 6 + [f"the same long text in all of them no {k}" for k in range(6)] + [f"own page {k}" for k in range(6)]
    assert [got[k] for k in range(len(pages))] == want


# --- 6, 8

def brute_ids(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    return [(d, np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")) for d, x in rows]


def test_packing(spark):
    from corvane.llm.packing import pack

    rows = corpus()
    out = pack(frame(spark, rows), BPE, 64, 2).collect()
    ids = brute_ids(rows)
    assert sum(x["length"] for x in out) == sum(len(v) for _, v in ids)
    want = sorted((-1 if d is None else d, j, s, n, zlib.crc32(v[s : s + n].tobytes())) for d, v in ids for j, (s, n) in enumerate([(0, len(v))] if len(v) <= 64 else [(0, len(v) % 64)] * bool(len(v) % 64) + [(s, 64) for s in range(len(v) % 64, len(v), 64)]))
    assert sorted((-1 if x["doc_id"] is None else x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in out) == want
    bins = {}
    for x in out:
        bins.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 64
    least = -(-sum(x["length"] for x in out) // 64)
    assert len(bins) <= least + 2
    no_rows(pack(frame(spark, []), BPE))


def test_packing_search_against_best():
    from corvane.llm.packing import best_fit, crossover, evolve, intervals

    r = random.Random(4)
    hist = {n: r.randrange(1, 30) for n in r.sample(range(1, 100), 40)}
    pop = evolve(hist, 100, [], 1, 10, 4)
    for bins in (*pop, crossover(pop[0], pop[-1], hist, 100, r), best_fit(hist, 100)):
        total = {}
        for p, m in bins.items():
            assert sum(n * k for n, k in p) <= 100
            for n, k in p:
                total[n] = total.get(n, 0) + k * m
        assert total == hist
    assert sum(pop[0].values()) <= sum(best_fit(hist, 100).values())
    assert (np.diff(intervals(pop[0])["key"]) > 0).all()


def test_records(spark, tmp_path):
    from corvane.llm import records as R

    rows = corpus()
    out = R.token_records(frame(spark, rows), BPE, 2, str(tmp_path / "r")).collect()
    ids = sorted(brute_ids(rows), key=lambda x: (x[0] is not None, x[0]))
    assert sorted(-1 if x["doc_id"] is None else x["doc_id"] for x in out) == sorted(-1 if d is None else d for d, _ in ids)
    at, want = 0, []
    for d, v in ids:
        want.append((-1 if d is None else d, at, len(v), zlib.crc32(v.tobytes())))
        at += len(v)
    assert sorted((-1 if x["doc_id"] is None else x["doc_id"], x["start"], x["n_tokens"], x["ids_crc32"]) for x in out) == sorted(want)
    no_rows(R.token_records(frame(spark, []), BPE, 2, str(tmp_path / "e")))
    raw = bytearray(R.frame(R.payload(None, ids[3][1].tobytes())))
    data, end = R.record(raw, 0)
    assert end == len(raw) and R.parse(data) == (None, ids[3][1].tobytes())
    assert R.parse(R.payload(7, np.array([70000], "<u4").tobytes())) == (7, np.array([70000], "<u4").tobytes())
    for k in (0, 15, len(raw) - 1):
        bad = bytearray(raw)
        bad[k] ^= 1
        with pytest.raises(ValueError):
            R.record(bad, 0)
    shards = sorted((int(p.name[6:12]), 0) for p in (tmp_path / "r").glob("*.rec"))
    a, b = (R.read_token_records(spark, str(tmp_path / "r"), shards, seed).collect() for seed in (None, 3))
    assert sorted(map(str, a)) == sorted(map(str, b)) and list(a) != list(b)


# --- 7

def test_sentencepiece(spark):
    import sentencepiece

    from corvane.llm.sentencepieces import Pieces, encode_documents

    model = tokenizer_file("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    rows = [*corpus(), (200, "  two  spaces\tand\r\n\n"), (201, "▁x ▁"), (202, "😀" * 90), (203, "a" * 300 + " " + "the" * 90), (204, "<s></s><0x41>"), (205, " ")]
    got = {(x["doc_id"], x["ids_crc32"]): x for x in encode_documents(frame(spark, rows), model, keep_ids=True).collect()}
    for d, t in rows:
        ids = sp.encode(t or "")
        x = got[(d, zlib.crc32(np.array(ids, "<u4").tobytes()))]
        assert x["ids"] == ids and x["round_trip"] and x["decoded_crc32"] == zlib.crc32(sp.decode(ids).encode())
    p = Pieces(model, words=50)  # a full cache changes nothing
    for _, t in rows:
        assert np.frombuffer(p.encode([t or ""])[0], "<u4").tolist() == sp.encode(t or "")
    no_rows(encode_documents(frame(spark, []), model))


# --- 9

@pytest.mark.parametrize(("k", "num", "bands", "rows_"), [(3, 85, 24, 6), (5, 80, 28, 5)])
def test_minhash(spark, k, num, bands, rows_):
    from corvane.llm.minhash import minhash_dedup, word_set

    rows = corpus(11, 120)
    out = minhash_dedup(frame(spark, rows), k=k, num=num, den=100, bands=bands, rows=rows_).collect()
    sets = [word_set(t, k) for _, t in rows]
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    root = roots(len(rows), links)
    comp = {}
    for i, g in enumerate(root):
        comp.setdefault(g, []).append(rows[i][0])
    want = sorted((-1 if rows[i][0] is None else rows[i][0], len(sets[i]), min((x for x in comp[root[i]] if x is not None), default=-1)) for i in range(len(rows)))
    assert len(links) > 20 and sorted((-1 if x["doc_id"] is None else x["doc_id"], x["n_shingles"], x["component_id"]) for x in out) == want
    no_rows(minhash_dedup(frame(spark, [])))


def test_tiles_find_links_the_star_misses(spark):
    """A chain in one bucket: neighbours are similar, the ends are not."""
    from corvane.llm.minhash import minhash_dedup

    words = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(words[3 * k : 3 * k + 120])) for k in range(20)]
    out = minhash_dedup(frame(spark, rows), k=3, num=85, den=100, bands=60, rows=3).collect()
    assert {x["component_id"] for x in out} == {0}


# --- 10

def test_edit_counts(spark):
    from corvane.llm.edit_counts import Counter, CountTree, edited_counts

    c, r = Counter(BPE), random.Random(8)
    bits = (" ", "\n", "'s", "a", "é", "12", " the", "日", "\xa0", "!!", "", "x" * 40)
    for _, t in [*corpus(n=20), (0, "\n\n  \n"), (0, "it's  we're")]:
        tree, text = CountTree(c, t or ""), t or ""
        for _ in range(25):
            at, cut, new = r.randrange(len(text) + 1), r.choice((0, 1, 7, 60)), "".join(r.choice(bits) for _ in range(r.randrange(4)))
            tree.edit(at, cut, new)
            text = text[:at] + new + text[at + cut :]
            assert tree.text() == text and tree.length == len(text)
            assert tree.total == len(c.lib.encode(text, add_special_tokens=False).ids)
    edits = "array(named_struct('at', 3, 'cut', 2, 'text', ' new'), null, named_struct('at', -5, 'cut', null, 'text', null))"
    df = frame(spark, corpus()).withColumn("edits", F.expr(f"if(doc_id = 7, null, {edits})"))
    for x, t in ((x, dict(corpus())[x["doc_id"]] or "") for x in edited_counts(df, BPE).collect() if x["doc_id"] not in (None, 5)):
        at = min(3, len(t))
        after = t if x["doc_id"] == 7 else t[:at] + " new" + t[at + 2 :]
        assert (x["n_tokens"], x["n_tokens_after"], x["n_chars_after"]) == (*(len(c.lib.encode(y, add_special_tokens=False).ids) for y in (t, after)), len(after))
    no_rows(edited_counts(df.limit(0), BPE))


# --- queries and the pipeline

def test_oracle(spark):
    import duckdb

    from corvane.llm import queries as q

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    for name, sql in q.oracle_sql().items():
        df, want = q.queries()[name](spark, SF), con.sql(sql)
        names = sorted(df.columns)
        assert sorted(want.columns) == names
        assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(tuple(r[want.columns.index(c)] for c in names) for r in want.fetchall())


def test_pipeline(spark):
    import corpus_pipeline as cp
    from corvane.llm.minhash import word_set
    from corvane.llm.toxicity import score, train

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    bad = {r["doc_id"] for r in score(docs, train(docs, labels), ["doc_id"]).filter("toxic").collect()}
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect() if r["doc_id"] not in bad)
    last = {t: d for d, t in rows}
    rows = sorted((d, t) for t, d in last.items())
    sets = [word_set(t, 5) for _, t in rows]
    root = roots(len(rows), [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    want = {rows[i][0] for i in range(len(rows)) if root[i] == i}
    assert {r["doc_id"] for r in cp.run(spark, SF).select("doc_id").distinct().collect()} == want
    assert [n for n, _ in cp.STAGES] == ["toxicity", "exact_dedup", "minhash_near_dedup", "best_fit_packing"]


def tagged(spark, rows):
    return spark.createDataFrame([(d, t, f"r{k}") for k, (d, t) in enumerate(rows)], "doc_id long, text string, tag string").repartition(3)


def test_near_stage_keeps_rows_without_ids(spark):
    """Rows without ids: unique ones stay, and of a group one, that with the least id if any has an id."""
    import corpus_pipeline as cp

    texts = [" ".join(f"w{g}x{i}" for i in range(60)) for g in range(4)]
    near = [t + " tail" for t in texts]
    rows = [(None, texts[0]), (None, texts[1]), (None, near[1]), (7, texts[2]), (None, near[2]), (None, near[2]), (None, None), (None, " "), (8, texts[3]), (9, near[3])]
    df = tagged(spark, rows)
    out = cp.near_stage(spark, df, SF)
    assert out.columns == df.columns
    got = {r["tag"] for r in out.collect()}
    assert out.count() == len(got) == 6 and len(got & {"r1", "r2"}) == 1 and got - {"r1", "r2"} == {"r0", "r3", "r6", "r7", "r8"}


def test_stages_decide_by_row_where_ids_repeat(spark):
    """A kept row doesn't keep the other rows of its id, and rows equal in id and text are one."""
    import corpus_pipeline as cp

    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(7, a), (7, b), (9, b), *[(5, c)] * 6, (None, b), (None, "alone"), (None, "alone too")]
    df = tagged(spark, rows)
    got = [r["tag"] for r in cp.exact_stage(spark, df, SF).collect()]
    assert len(got) == 5 and {"r0", "r2", "r10", "r11"} < set(got) and set(got) & {f"r{k}" for k in range(3, 9)}
    rows = [(7, a), (7, b + " tail"), (3, b), *[(5, c)] * 6]
    got = [r["tag"] for r in cp.near_stage(spark, tagged(spark, rows), SF).collect()]
    assert len(got) == 3 and {"r0", "r2"} < set(got)


def test_pipeline_packs_one_row_of_a_group(spark, tmp_path):
    """The whole pipeline on repeated ids, with equal and unequal texts, and on rows without ids."""
    import corpus_pipeline as cp

    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(7, a), (7, b), (9, b), (9, b), *[(5, c)] * 6, (4, c + " tail"), (None, d), (None, d), (None, "alone")]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc_id", F.col("doc_id") + (1 << 40))
    docs.unionByName(made, allowMissingColumns=True).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    out = cp.run(spark, str(tmp_path)).filter(F.col("doc_id").isNull() | (F.col("doc_id") >= 1 << 40)).collect()
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] - (1 << 40) for r in out) == [-1, -1, 4, 7, 9]
