"""Token alignment, languages and periodic runs against brute force, with nulls, blanks, long texts, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from corvane.llm.common import tokenizer_file

A_FILE, B_FILE = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, row string, t string, n_a string, held_out string, start string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, lang, "x", "y", "z", "w", "v") for d, t, lang in rows], DOCS).repartition(3)


# --- 11

def brute_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    from corvane.llm.alignment import byte_letters

    a_lib, b_lib, letter = Tokenizer.from_file(A_FILE), sentencepiece.SentencePieceProcessor(model_file=B_FILE), byte_letters()
    a_lib.encode_special_tokens = True

    def spans(parts):
        ends = np.cumsum([len(p) for p in parts]).tolist()
        return list(zip([0, *ends], ends))

    out = []
    for text in texts:
        if not text:
            out.append(None)
            continue
        a, b, raw = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text), (" " + text).encode()
        of_a = [bytes(letter[c] for c in a_lib.id_to_token(i)) for i in a]
        of_b = [bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(of_a) != raw or b"".join(of_b) != raw:
            out.append(None)
            continue
        at_a, at_b = spans(of_a), spans(of_b)
        cuts = sorted({e for _, e in at_a} & {e for _, e in at_b})
        parts, links = [], []
        for s, e in zip([0, *cuts], cuts):
            x, y = ([k for k, (i, j) in enumerate(at) if s <= i and j <= e] for at in (at_a, at_b))
            parts.append(",".join(str(a[k]) for k in x) + "|" + ",".join(str(b[k]) for k in y))
            links += [(a[p], b[q]) for p in x for q in y if at_a[p][0] < at_b[q][1] and at_b[q][0] < at_a[p][1]]
        out.append((len(a), len(b), len(parts), links, ";".join(parts)))
    n, most = defaultdict(int), defaultdict(int)
    for o in out:
        for p in set(o[3]) if o else ():
            n[p] += 1
    for (a, _), c in n.items():
        most[a] = max(most[a], c)
    return [(0,) * 6 + ("",) if o is None else (*o[:3], len(o[3]), sum(n[p] == most[p[0]] for p in o[3]), sum(n[p] for p in o[3]), hashlib.sha256(o[4].encode()).hexdigest()) for o in out]


ODD = [None, "", " ", "  ", "\n", "a\tb \n c", "foo\n  bar\t ", "▁ x", "<|endoftext|> <s> </s> <unk>", "日本語 テキスト　全角", "\x1c a \x1d", "it's  we'll\r\n ok", "\x00 nul", "a\u0085 b", "﻿ bom", "١٢٣ ½ ²", " \t \n x", "  y", "é w"]


@pytest.mark.parametrize("few", [2_000_000, 300, 0])
def test_alignment(spark, few):
    from corvane.llm.alignment import align_documents

    r = random.Random(few)
    texts = ODD + ["".join(r.choice(" \n\t\ra'sé日1. ▁\x1c<|>") for _ in range(r.randrange(40))) for _ in range(300)]
    texts += ["the same text again", "the same text again", "word, " * 3000 + "x" * 2000]
    df = frame(spark, [(k if k != 20 else None, t, None) for k, t in enumerate(texts)])
    got = {(-1 if x[0] is None else x[0]): tuple(x)[1:] for x in align_documents(df, A_FILE, B_FILE, few=few).collect()}
    want = brute_alignment(texts)
    assert len(got) == len(texts)
    assert [got[k if k != 20 else -1] for k in range(len(texts))] == want


def test_alignment_groups_and_no_rows(spark):
    from corvane.llm.alignment import align_documents

    out = align_documents(frame(spark, [(1, "hello world", None), (2, "", None)]), A_FILE, B_FILE, keep_groups=True).collect()
    text = {x["doc_id"]: x for x in out}
    assert hashlib.sha256(text[1]["groups"].encode()).hexdigest() == text[1]["groups_sha256"] and text[2]["groups"] == text[2]["groups_sha256"] == ""
    assert align_documents(frame(spark, []), A_FILE, B_FILE).count() == 0


def test_alignment_forgets_little_used_chunks():
    from corvane.llm.alignment import Aligner

    small, large = Aligner(A_FILE, B_FILE, words=40), Aligner(A_FILE, B_FILE)
    r = random.Random(2)
    for _ in range(20):
        texts = [" ".join(f"w{r.randrange(60)}" for _ in range(30)) for _ in range(4)]
        got = []
        for x in (small, large):
            at, of, _ = x.chunks_of(texts)
            got.append((x.size[at].tolist(), of.tolist(), [x.text[i] for i in at], x.pairs_of(at)[0].tolist()))
        assert got[0] == got[1]
    assert len(small.index) < 110


# --- 12

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "ei", "ver"], "cc": ["ão", "ê", "lh", "qu"]}


def prose(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def test_languages(spark):
    from corvane.llm.language import predict_languages

    r = random.Random(4)
    rows = [(k, prose(r, "abc"[k % 3] * 2, r.randrange(8, 60)), "abc"[k % 3] * 2) for k in range(300)]
    rows += [(1000, prose(r, "aa", 60) + " " + prose(r, "bb", 40), None), (1001, None, "aa"), (1002, "", "bb"), (1003, "123 ... ½²", "cc"), (1004, "A.", None)]
    rows += [(None, prose(r, "aa", 30), "bb"), (5, rows[5][1], rows[5][2]), (1005, prose(r, "cc", 200_000), None)]
    out = predict_languages(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    got = {x["doc_id"]: x for x in out}
    assert all(got[k]["lang_pred"] == lang for k, _, lang in rows[:300]) and got[1005]["lang_pred"] == "cc"
    assert all(x["held_out"] == (x["doc_id"] is not None and zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in out)
    assert got[1000]["languages"] == ["aa", "bb"] and abs(got[1000]["proportions"][0] - 0.55) < 0.15 and 0.3 < got[1000]["score"] < 0.8
    assert [got[k]["lang_pred"] for k in (1001, 1002, 1003)] == ["und"] * 3 and got[1003]["score"] == 0
    assert got[1004]["lang_pred"] in SYLLABLES and got[None]["lang_pred"] == "aa" and not got[None]["held_out"]
    assert all(0 <= x["score"] <= 1 for x in out)
    assert predict_languages(frame(spark, [])).count() == 0
    assert [x["lang_pred"] for x in predict_languages(frame(spark, [(1, "text without labels", None)])).collect()] == ["und"]


def test_held_out_labels_are_not_learned(spark):
    """Changing labels, and texts' labels, of the held-out fold changes nothing."""
    from corvane.llm.language import predict_languages

    r = random.Random(5)
    rows = [(k, prose(r, "ab"[k % 2] * 2, 20), "ab"[k % 2] * 2) for k in range(200)]
    held = {k for k in range(200) if zlib.crc32(str(k).encode()) % 5 == 0}
    both = [sorted(tuple(x)[:4] for x in predict_languages(frame(spark, x)).collect()) for x in (rows, [(k, t, "zz" if k in held else lang) for k, t, lang in rows])]
    assert both[0] == both[1] and len(held) > 20


def test_proportions_are_the_likeliest():
    """EM's proportions on one document against a grid."""
    from corvane.llm.language import Mixture

    r = np.random.default_rng(1)
    p = r.dirichlet(np.ones(6), 2).astype(np.float32)
    count = np.array([5, 0, 3, 9, 1, 2], np.float32) + 1
    theta, fit = Mixture(["a", "b"], np.log(p), 3).proportions(p, count, np.array([0]), np.ones((2, 1)), rounds=400)
    grid = np.linspace(0, 1, 2001)
    values = [(count * np.log(g * p[0] + (1 - g) * p[1])).sum() for g in grid]
    assert abs(grid[int(np.argmax(values))] - theta[0, 0]) < 0.01 and abs(max(values) - fit[0]) < 1e-3


# --- 13

def brute_runs(s):
    out = []
    for q in range(1, len(s) // 2 + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            n = j - i + q
            if n >= 2 * q and not any(all(s[x] == s[x + p] for x in range(i, i + n - p)) for p in range(1, q)):
                out.append((i, n, q))
            i = j + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_all_runs_of_strings():
    from corvane.llm.periodic import runs

    r = random.Random(7)
    for _ in range(1500):
        n, letters = r.randrange(0, 60), r.choice((1, 2, 2, 3, 4))
        s = [r.randrange(letters) for _ in range(n)]
        if n and r.random() < 0.5:
            s = (s[: r.randrange(1, n + 1)] * r.randrange(1, 5) + s)[:80]
        got = sorted(zip(*(x.tolist() for x in runs(np.array(s, np.int64)))), key=lambda x: (x[0], x[2]))
        assert got == brute_runs(s), s


def test_one_letter_many_times():
    from corvane.llm.periodic import runs

    assert [x.tolist() for x in runs(np.zeros(30_000, np.int64))] == [[0], [30_000], [1]]


def wanted(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = [x for x in brute_runs(w) if x[1] >= max(6, 4 * x[2])]
    gone = {k for i, m, q in found for k in range(i + q, i + m)}
    best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if found else (None,) * 3
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{i},{m},{q}\n" for i, m, q in found), " ".join(x for k, x in enumerate(w) if k not in gone))]
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, *sha)


def test_periodic_runs(spark):
    from corvane.llm.periodic import periodic_runs

    r = random.Random(9)
    rows = []
    for k in range(250):
        w = [r.choice("abcde") for _ in range(r.randrange(40))]
        for _ in range(r.randrange(3)):
            part, at = [r.choice("abcd") for _ in range(r.randrange(1, 6))], r.randrange(len(w) + 1)
            w[at:at] = part * r.randrange(2, 8)
        rows.append((k, r.choice((" ", "\n", " \t ")).join(w), None))
    rows += [(1000, None, None), (1001, "", None), (1002, " \n\x0b ", None), (None, "a " * 9, None), (3, rows[3][1], None), (1003, "é b " * 7, None)]
    out = sorted((tuple(x) for x in periodic_runs(frame(spark, rows), repeat=True).collect()), key=repr)
    assert out == sorted((wanted(d, t) for d, t, _ in rows), key=repr)
    assert sum(x[1] > 0 for x in out) > 60
    assert periodic_runs(frame(spark, [])).count() == 0


def test_periodic_runs_of_a_very_long_text(spark):
    from corvane.llm.periodic import periodic_runs

    words = [f"w{k % 40_000}" for k in range(200_000)]
    x = periodic_runs(frame(spark, [(1, " ".join(words), None)]), keep_text=True).collect()[0]
    assert (x["n_runs"], x["start"], x["length"], x["period"], x["exponent_milli"]) == (1, 0, 200_000, 40_000, 5000)
    assert x["collapsed"].split() == words[:40_000] and len(x["runs"]) == 1
