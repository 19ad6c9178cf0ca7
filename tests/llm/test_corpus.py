"""Corpus operators against brute force, and their edge cases: nulls, empty texts and tables, ties, repeats, odd columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidegrid.llm import bpe, chat, decontaminate, graph, licenses, neardup, passages, quality, sharding, substring, topk, toxicity
from tidegrid.llm.textscan import texts_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, h long"


def documents(spark, texts, ids=None):
    """With extra columns whose names the operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", 1) for i, t in zip(ids, texts, strict=True)], DOCS)


def prose(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re"]) for _ in range(rng.randint(1, 5))) for _ in range(n))


# --- top-k


def test_topk_equals_brute_force_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(0)
    x = [(i, [float(v) for v in rng.normal(size=6).round(1)]) for i in range(120)]
    x += [(200 + i, [0.5] * 6) for i in range(60)] + [(400, None), (401, [1.0, None, 1.0]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, "a") for i, v in x] + [(0, x[0][1], "a")], "vec_id long, embedding array<double>, q string")
    got = topk.top_k(df, df.filter(F.pmod("vec_id", F.lit(20)) == 0), k=7).collect()
    fine = {i: [int(np.floor(64 * v)) for v in e] for i, e in x if i is not None and e and None not in e and np.isfinite(e).all()}
    want = []
    for q in sorted(i for i in fine if i % 20 == 0):
        s = sorted((-sum(a * b for a, b in zip(fine[q], fine[i], strict=True)), i) for i in fine if i != q)[:7]
        want += [(q, r + 1, i, -v) for r, (v, i) in enumerate(s)]
    assert sorted(tuple(r) for r in got) == want
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
    few = df.filter("vec_id in (20, 21, 22)")
    assert topk.top_k(few, few.filter("vec_id = 20"), k=7).count() == 2


def test_topk_of_huge_components_is_exact(spark):
    df = spark.createDataFrame([(0, [2.0**40, 1.0]), (1, [2.0**10, 3.0]), (2, [2.0**10, 4.0])], "vec_id long, embedding array<double>")
    got = topk.top_k(df, df.filter("vec_id = 0"), k=2).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(2, 2**46 * 2**16 + 64 * 256), (1, 2**46 * 2**16 + 64 * 192)]


def test_topk_keeps_rows_that_are_equal_only_after_scaling(spark):
    df = spark.createDataFrame([(0, [1.0, 1.0]), (1, [0.5, 0.5]), (1, [0.501, 0.5]), (1, [0.501, 0.5]), (2, [0.1, 0.1])], "vec_id long, embedding array<double>")
    got = topk.top_k(df, df.filter("vec_id = 0"), k=5).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 64 * 64), (1, 64 * 64), (2, 64 * 12)]


def test_topk_prunes_by_norms_and_stays_exact(spark):
    rng = np.random.default_rng(3)
    x = [(i, [float(v) for v in rng.normal(size=8) * rng.choice([0.01, 0.1, 1, 30])]) for i in range(400)]
    df = spark.createDataFrame(x, "vec_id long, embedding array<double>")
    q = {i: np.floor(64 * np.array(v)).astype(int) for i, v in x}
    got = {}
    for r in topk.top_k(df, df.filter("vec_id % 20 = 0"), k=9, lists=3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for i in range(0, 400, 20):
        best = sorted((-int(q[i] @ q[j]), j) for j in q if j != i)[:9]
        assert sorted(got[i]) == [(k + 1, j, -s) for k, (s, j) in enumerate(best)]


# --- BPE

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_bpe_equals_the_library():
    ranks = bpe.load_ranks(PATH)
    mine = bpe.Tokenizer(ranks, public_tokenizers.PATTERN)
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    alphabet = ["a", "b", " ", "\n", "\t", "é", "日", "'s", "'", "1", "!", "  ", "the", "tion", "\r\n", "😀", "\x1c", "\x85", "​"]
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        ids = mine.encode(text)
        assert ids == theirs.encode_ordinary(text) and mine.decode_bytes(ids).decode() == text and "".join(mine.decode_stream(ids)) == text
    assert mine.encode("ab" * 5000) == theirs.encode_ordinary("ab" * 5000)
    small = bpe.Transducer(ranks, most_states=50)  # forgets its states again and again
    some = prose(rng, 200).split()
    assert all(list(small.encode(w.encode())) == theirs.encode_ordinary(w) for w in some)
    assert all(list(small.stream(w.encode())) == theirs.encode_ordinary(w) for w in some)
    long = "".join(rng.choice(["th", "er", "é", "日", "tion"]) for _ in range(2000))
    assert list(small.stream(long.encode())) == theirs.encode_ordinary(long) == list(small.encode(long.encode()))


def test_bpe_borders_follow_the_defining_rule():
    t = bpe.Transducer(bpe.load_ranks(PATH))
    rng = random.Random(19)
    some = [i for i in t.spelled if t.merged(t.spelled[i]) == [i]]
    for _ in range(3000):
        a, b = rng.choice(some), rng.choice(some)
        assert t._stands(a, b) == (t.merged(t.spelled[a] + t.spelled[b]) == [a, b])


def test_bpe_stream_needs_bounded_lookahead():
    t = bpe.Transducer(bpe.load_ranks(PATH))
    longest, text = int(t.length.max()), prose(random.Random(20), 300).replace(" ", "").encode()
    read, given = 0, 0

    def bytes_read():
        nonlocal read
        for b in text:
            read += 1
            yield b

    for i in t.stream(bytes_read()):
        given += len(t.spelled[i])
        assert read - given <= 2 * longest or read == len(text)
    assert given == len(text)


def test_utf8_machine_at_every_cut():
    data = "aé日😀߿￿".encode() + b"\xff\xe0\x80\xf0\x9f\xc3" + "z".encode() + b"\xe6\x97"
    for cut in range(len(data) + 1):
        m = bpe.Utf8()
        assert m.feed(data[:cut]) + m.feed(data[cut:]) + m.end() == data.decode("utf-8", "replace")


def test_bpe_query_columns(spark):
    rows = {r.doc_id: r for r in bpe.encode_documents(documents(spark, ["hello world", "", None]), PATH, public_tokenizers.PATTERN).collect()}
    assert rows[1].n_tokens == rows[2].n_tokens == 0 and rows[2].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert rows[0].decoded_sha256 == hashlib.sha256(b"hello world").hexdigest() and rows[0].round_trip


# --- decontamination


def brute_hits(text, items, size=10):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = lambda t: word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, found = low(text), set(), set()
    for i, t in items:
        iw = low(t)
        for a in range(max(1, len(iw) - size + 1) if iw else 0):
            win = iw[a : a + size]
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit |= set(range(p, p + len(win)))
                    found.add(i)
    return len(w), len(hit), found


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_decontamination_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    rng = random.Random(5)
    items = [(k, prose(rng, 25)) for k in range(8)] + [(20, "Zwölf Äpfel 7"), (21, ""), (22, None), (23, items_tail := prose(rng, 12)), (24, items_tail)]
    texts = ["", None, "...", prose(rng, 60)]
    for _ in range(25):
        i, t = rng.choice([x for x in items if x[1]])
        w = t.split()
        a = rng.randint(0, max(0, len(w) - 11))
        texts.append(prose(rng, rng.randint(0, 9)) + " " + ", ".join(w[a : a + rng.randint(8, 25)]).upper() + "\n" + prose(rng, 5) + rng.choice([" zwölf äpfel, 7", ""]))
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, texts)
    got = {r.row.doc_id: r for r in decontaminate.find_matches(docs, bench).collect()}
    for k, t in enumerate(texts):
        n, hit, found = brute_hits(t, items)
        assert (got[k].n_words, got[k].n_hit, set(got[k]["items"])) == (n, hit, found)
        assert got[k].items_sha256 == hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k in got if not got[k].n_hit}
    assert decontaminate.find_matches(docs, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.find_matches(docs.limit(0), bench).count() == 0


# --- chat


def test_chat_round_trip_of_hostile_texts(spark):
    rng = random.Random(1)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_end|>", "\\", "<", "[", ">", " ", "\n", "ok", "<\\/s>", "é"]
    rows = [(c, t, rng.choice(["user", "assistant", "sys</s>", None, "a b"]), rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))]), "x") for c in range(60) for t in range(rng.randint(1, 5))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    made = chat.format_chats(df)
    assert made.filter(~F.col("round_trip")).count() == 0
    for r in chat.read_chats(made).collect():
        own = [(x[2] or "", x[3] or "") for x in rows if x[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == own
        assert r.loss == "".join(t for role, t in own if role == "assistant")
    plain = chat.format_chats(spark.createDataFrame([(1, 0, "user", "hi")], "conv_id long, turn long, role string, text string")).first()
    assert plain.formatted == "<s>[INST] user [/INST]hi</s>" and not plain.escaped
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_mask_of_a_long_conversation(spark):
    turns = [("assistant" if t % 3 else "user", "x" * (t % 5) + ("</s>" if t % 97 == 0 else "é")) for t in range(3 * chat.BLOCK_TURNS + 1)]
    df = spark.createDataFrame([(1, t, *x) for t, x in enumerate(turns)], "conv_id long, turn long, role string, text string")
    made = chat.format_chats(df)
    r = chat.read_chats(made).first()
    assert [tuple(t) for t in r.turns] == turns and r.loss == "".join(t for role, t in turns if role == "assistant")
    m = made.first()
    assert m.escaped and m.round_trip and len(m["mask"]) == sum(role == "assistant" for role, _ in turns)


# --- sharding


def test_sharding_balances_with_a_hot_text(spark):
    rng = random.Random(2)
    texts = [prose(rng, rng.randint(1, 60)) for _ in range(1500)] + ["the same text in every one of these rows"] * 800 + [None, ""]
    docs = documents(spark, texts, [*range(2000), *([5] * 300), 2301, None])
    got = sharding.assign_shards(docs, 8).collect()
    assert len(got) == len(texts)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    sizes = [sum(x.size for x in v) for v in by.values()]
    assert len(by) == 8 and max(sizes) - min(sizes) <= 0.05 * sum(sizes) / 8 + 400
    assert all(sorted(x.slot for x in v) == list(range(len(v))) for v in by.values())
    spread = {}
    for r in got:
        spread.setdefault(r.text_crc32, set()).add(r.shard)
    assert sum(len(s) > 1 for s in spread.values()) <= 1 + 8
    r = next(x for x in got if x.doc_id == 7)
    assert (r.size, r.text_crc32) == (len(texts[7].encode()) + 16, zlib.crc32(texts[7].encode()))
    assert sharding.assign_shards(docs.limit(0), 8).count() == 0
    plan = sharding.assign_shards(docs, 8)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_sharding_equals_the_law(spark):
    """Rows in the order of hash and id; a shard has what has its middle in its part of all bytes; small groups are one row."""
    import xxhash

    rng = random.Random(22)
    texts = [prose(rng, rng.randint(1, 80)) for _ in range(500)]
    texts += [t for t in texts[:30] for _ in range(3)] + ["hot " * 40] * 300 + ["", None]
    got = sorted((r.doc_id, r.shard, r.slot) for r in sharding.assign_shards(documents(spark, texts), 8).collect())
    key = lambda t: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64_intdigest((t or "").encode(), 42))
    rows = sorted((key(t), i, len((t or "").encode()) + 16) for i, t in enumerate(texts))
    total, at, start = sum(r[2] for r in rows), 0, {}
    group = {}
    for h, i, size in rows:
        start[i] = at
        group.setdefault(h, [at, 0])[1] += size
        at += size
    want, slots = [], {}
    for h, i, size in rows:
        a, n = group[h] if group[h][1] * sharding.TOGETHER * 8 <= total else (start[i], size)
        shard = min(7, (a + n // 2) * 8 // total)
        want.append((i, shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
    assert got == sorted(want)


# --- substring


def brute_units(text):
    """(first line, last line, normalised text) of lines and paragraphs."""
    lines = [" ".join(x.lower().split()) for x in (text or "").split("\n")]
    out = [(k, k, x) for k, x in enumerate(lines) if x]
    k = 0
    while k < len(lines):
        e = k
        while e < len(lines) and lines[e]:
            e += 1
        if e - k > 1:
            out.append((k, e - 1, " ".join(lines[k:e])))
        k = e + 1
    return out


def brute_removed(rows):
    """Of each row, its removed lines; rows in the order of their rank."""
    seen, out = {}, []
    for r, text in enumerate(rows):
        dead = set()
        start = [0]
        for x in (text or "").split("\n"):
            start.append(start[-1] + len(x) + 1)
        for a, b, norm in sorted(brute_units(text), key=lambda u: (start[u[0]], start[u[1] + 1])):
            if norm in seen:
                dead |= set(range(a, b + 1))
            seen.setdefault(norm, r)
        out.append(dead)
    return out


def substring_texts(rng):
    lines = [prose(rng, rng.randint(1, 20)) for _ in range(40)] + ["", " \t", "日本語の長い一行", ""]
    texts = ["\n".join(rng.choice(lines).upper() if rng.random() < 0.3 else "  " + rng.choice(lines) for _ in range(rng.randint(0, 8))) for _ in range(60)]
    wrapped = [prose(rng, 60) for _ in range(3)]
    for w in wrapped * 2:
        words = w.split()
        for k in sorted(rng.sample(range(1, 60), 4)):
            words[k] = "\n" + words[k]
        texts.append(prose(rng, 5) + "\n\n" + " ".join(words) + "\n \n" + prose(rng, 4))
    return texts + [None, "", "\n\n", wrapped[0]]


def test_substring_equals_brute_force(spark):
    texts = substring_texts(random.Random(4))
    texts += texts[:5] * 2
    docs = documents(spark, texts)
    want = brute_removed(texts)
    got = {r.doc_id: r for r in substring.report(docs).collect()}
    for i, (t, dead) in enumerate(zip(texts, want, strict=True)):
        lines = (t or "").split("\n")
        full = [k for k, x in enumerate(lines) if x.strip()]
        assert (got[i].n_lines, got[i].n_removed, got[i].removed_words) == (len(full), len(dead & set(full)), sum(len(lines[k].split()) for k in dead))
        parts = [t[x.start : x.start + x.length] for x in got[i].spans]
        assert [x.strip() for p in parts for x in p.split("\n") if x.strip()] == [lines[k].strip() for k in full if k in dead]
        assert got[i].longest_removed == max((len(p.split()) for p in parts), default=0) and got[i].repeats_passage == (got[i].longest_removed > 50)
    out = substring.drop_repeats(docs)
    assert out.columns == docs.columns
    rest = {i: t if not dead else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in dead) for i, (t, dead) in enumerate(zip(texts, want, strict=True))}
    assert {r.doc_id: r.text for r in out.collect()} == {i: t for i, t in rest.items() if not want[i] or t.strip()}
    assert all(r.text is None or r.n_chars == len(r.text) for r in out.collect())
    for f in (substring.repeats, substring.report, substring.drop_repeats):
        assert f(docs.limit(0)).count() == 0


def test_substring_with_equal_rows_and_null_ids(spark):
    line = "one line of text that stands in many rows"
    docs = documents(spark, [line] * 4 + [line + " more", None], [3, 3, None, None, 3, None])
    got = sorted((r.doc_id is None, r.n_removed) for r in substring.report(docs).collect())
    assert got == [(False, 0), (False, 1), (False, 1), (True, 0), (True, 0), (True, 1)]
    left = sorted((str(r.doc_id), str(r.text)) for r in substring.drop_repeats(docs).collect())
    assert left == sorted([("3", line + " more"), ("None", line), ("None", "None")])
    assert {r.first_doc_id for r in substring.repeats(docs).collect()} == {None}


def brute_passages(texts):
    """Of each text, which of its words lie in 51 words that stand earlier."""
    seen, out = set(), []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        dead = [False] * len(w)
        for i in range(len(w) - 50):
            win = tuple(w[i : i + 51])
            if win in seen:
                dead[i : i + 51] = [True] * 51
            seen.add(win)
        out.append(dead)
    return out


def passage_texts(rng):
    shared = [prose(rng, n) for n in (51, 52, 80, 200, 50)]
    texts = [prose(rng, rng.randint(0, 60)) for _ in range(30)]
    for s in shared * 3:
        broken = "".join(x + rng.choice(["  ", "\n", " ", " "]) for x in s.split()).strip()
        texts.append(f"{prose(rng, rng.randint(1, 90))} {broken.upper() if rng.random() < 0.3 else broken} {prose(rng, rng.randint(1, 40))}")
    return texts + ["ein zwei drei " * 40, "so " * 300, "x " + "so " * 60, None, "", " \n", shared[3] + "é", texts[33], texts[33], prose(rng, 70)]


def test_passages_within_longer_lines(spark):
    texts = passage_texts(random.Random(8))
    docs = documents(spark, texts)
    got = {r.doc_id: r for r in passages.report(docs).collect()}
    want = brute_passages(texts)
    assert sum(map(any, want)) > 12
    for i, (t, dead) in enumerate(zip(texts, want, strict=True)):
        assert (got[i].n_words, got[i].repeated_words, got[i].repeats_passage) == (len(dead), sum(dead), any(dead))
        assert sum(len(t[s.start : s.start + s.length].split()) for s in got[i].spans) == sum(dead)
    assert passages.report(docs.limit(0)).count() == 0


def test_drop_repeats_takes_passages_out_of_longer_lines(spark):
    texts = passage_texts(random.Random(8))
    left = {r.doc_id: r.text for r in substring.drop_repeats(documents(spark, texts)).collect()}
    for i, (t, dead, gone) in enumerate(zip(texts, brute_passages(texts), brute_removed(texts), strict=True)):
        words = [(k, x) for k, line in enumerate((t or "").split("\n")) for x in line.split()]
        assert (left.get(i) or "").split() == [x for (k, x), d in zip(words, dead, strict=True) if not d and k not in gone]


# --- near duplicates


def brute_components(texts, k, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 20)
    rng = random.Random(6)
    texts = ["", None, " \n", "One", "one", "a b c", "A b  c", "a b c d", "a b c d e"]
    for n in (5, 8, 30, 200):
        for _ in range(3):
            base = prose(rng, n).split()
            texts.append(" ".join(base))
            for _ in range(14):
                w = list(base)
                for _ in range(rng.randint(0, max(1, n // 25))):
                    w[rng.randrange(len(w))] = prose(rng, 1) + "x"
                texts.append(" ".join(w))
    want = brute_components(texts, 4, 80)
    got = sorted(neardup.near_duplicates(documents(spark, texts), 4, 80).collect())
    assert [(r.n_shingles, r.component_id) for r in got] == want and all(r.kept == (r.component_id == r.doc_id) for r in got)
    assert neardup.near_duplicates(documents(spark, texts).limit(0)).count() == 0
    repeated = neardup.keep_one(documents(spark, ["x y z", "x y z", None], [3, 1, 2]), 5)
    assert sorted(r.doc_id for r in repeated.collect()) == [1, 2]


def test_one_row_of_a_group_stays_with_null_and_repeated_ids(spark):
    rng = random.Random(16)
    a, b, c, d, e, f = (prose(rng, 60) for _ in range(6))
    rows = [(5, a), (None, a), (None, b), (None, "  " + b.upper()), (None, c), (7, d), (7, a + " on"), (8, e), (8, e), (9, f), (9, f), (3, f), (None, None), (None, ""), (4, ""), (4, "")]
    got = neardup.keep_one(documents(spark, [t for _, t in rows], [i for i, _ in rows]), 5)
    assert got.columns == [x.split()[0] for x in DOCS.split(", ")]
    got = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert [x for x in got if x[1] and x[1].lower().strip() != b] == sorted([(5, a), (None, c), (7, d), (8, e), (3, f)], key=str)
    assert sum((x[1] or "").lower().strip() == b for x in got) == 1
    assert [x for x in got if not x[1]] == sorted([(None, None), (None, ""), (4, ""), (4, "")], key=str)


def test_registers_estimate_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    errors = []
    for _ in range(20):
        b = a.copy()
        b[:300] = rng.integers(0, 1 << 63, 300).astype(np.uint64)
        true = 2700 / 3300
        errors.append(float(neardup.estimate(neardup.registers(np.unique(a), 11), neardup.registers(np.unique(b), 11), neardup.chance(3000 / 128, 3000 / 128))) - true)
    assert abs(np.mean(errors)) < 0.03 and max(map(abs, errors)) < 0.2
    for small in range(1, 400):
        for large in range(small, small * 5 // 4 + 1):
            assert set(neardup.size_classes(small)) & set(neardup.size_classes(large))


def test_components_of_chains_and_stars(spark):
    links = [(bytes([k]), bytes([k + 1])) for k in range(40)] + [(b"\x80", bytes([k])) for k in range(129, 200)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(links, "a binary, b binary")).collect()}
    assert all(v == (b"\x00" if k[0] < 128 else b"\x80") for k, v in got.items()) and len(got) == 41 + 72


# --- classifiers


def test_quality_on_held_out_texts(spark):
    rng = random.Random(7)
    good = [prose(rng, 80) for _ in range(170)]
    bad = [x for _ in range(80) for x in (prose(rng, 80).upper().replace(" ", "!! "), " ".join([prose(rng, 1) + prose(rng, 1)] * 80))]
    model = quality.train(good[:150] + bad[:140], np.array([1] * 150 + [0] * 140), epochs=30)
    got = {r.row.doc_id: r.score for r in quality.score(documents(spark, good[150:] + bad[140:] + ["", None]), model).collect()}
    right = [(got[k] >= 0.7) == (k < 20) for k in range(40)]
    assert sum(right) >= 38
    assert got[40] == got[41] and 0 <= got[40] <= 1


def test_quality_scores_equal_brute_force():
    """Buckets of words, pairs and character n-grams, one by one, averaged."""
    rng = np.random.default_rng(5)
    per_bucket = rng.normal(size=1 << quality.BITS).astype(np.float32)
    texts = ["a", "", "ab  cd ab ab", "Äé 日本語 text x", "x" * 30, None, "one two two two"]
    data, at = texts_of(pa.array(texts))
    got = quality.logits(data, at, per_bucket, 0.25)

    def word(w):
        d, a = texts_of(pa.array([w]))
        return int(quality.words(d, a, quality.word_bytes("space"))[0][0])

    for t, z in zip(texts, got, strict=True):
        ws = (t or "").split()
        h = [word(w) for w in ws]
        buckets = [x >> (64 - quality.BITS) for x in h]
        for x, y in zip(h, h[1:], strict=False):
            buckets.append(quality.AGAIN if x == y else int(quality.mix(np.array([(x * 3 + y) % 2**64], np.uint64))[0]) >> (64 - quality.BITS))
        for n in (2, 3, 4):
            for k in range(len(t or "") - n + 1):
                g = 0
                for c in t[k : k + n]:
                    g = (g * 0x01000193 + ord(c)) % 2**32
                buckets.append((g * (0x9E3779B1 + 2 * n)) % 2**32 >> (32 - quality.BITS))
        want = (sum(float(per_bucket[b]) for b in buckets) / len(buckets) if buckets else 0) + 0.25
        assert abs(z - want) < 1e-4


def test_classifiers_on_empty_tables_and_null_ids(spark):
    model, machine = quality.train([], np.zeros(0, int)), toxicity.train([], np.zeros(0))
    some = documents(spark, ["a b", None, "a b"], [1, None, 1])
    for f, m in ((quality.score, model), (toxicity.score, machine)):
        assert f(some.limit(0), m).count() == 0 and f(some, m).count() == 3
    assert licenses.scan(some.limit(0)).count() == 0
    assert bpe.encode_documents(some.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
    assert sorted(str(r.doc_id) for r in bpe.encode_documents(some, PATH, public_tokenizers.PATTERN).collect()) == ["1", "1", "None"]


def test_toxicity_with_gaps_and_inserted_characters(spark):
    rng = random.Random(8)
    clean = [prose(rng, 60) for _ in range(200)]
    insult = lambda: rng.choice(["idiot", "worthless", "pathetic"])
    toxic = [f"{prose(rng, 30)}. {prose(rng, 5)} {insult()} {prose(rng, 5)}. {prose(rng, 20)}" for _ in range(40)]
    model = toxicity.train(clean[:180] + toxic[:30], np.array([0] * 180 + [1] * 30))
    tests = [*clean[180:], *toxic[30:], "on the idi.ot there", "thon Worthlesss! re", "an i d i o t on", "", None]
    got = [r.score for r in toxicity.score(documents(spark, tests), model).orderBy("row.doc_id").collect()]
    assert all(s < 0.5 for s in got[:20] + got[-2:]) and all(s >= 0.5 for s in got[20:-2])


def test_toxicity_beyond_the_bound_of_its_cache():
    rng = random.Random(18)
    texts = [f"{prose(rng, 9)} {w} x{k}q." for k in range(30) for w in ("idiot", "worthless")] + ["", None]
    model = toxicity.Model(["idiot", "worthless"], np.ones(2), -1.0)
    small, large = toxicity.Scorer(model, most=3), toxicity.Scorer(model)
    for s in range(0, len(texts), 20):
        assert small.score(pa.array(texts[s : s + 20])).tolist() == large.score(pa.array(texts[s : s + 20])).tolist()
    assert len(small.known) < len(large.known)


def brute_kernel(a, b):
    from itertools import combinations

    total = 0.0
    for i in combinations(range(len(a)), 3):
        for j in combinations(range(len(b)), 3):
            if all(a[x] == b[y] for x, y in zip(i, j, strict=True)):
                total += toxicity.DECAY ** (i[-1] - i[0] + j[-1] - j[0] + 2)
    return total


def test_kernel_equals_enumeration():
    for a, b in (("idiot", "id.iot"), ("abcab", "bacab"), ("aaa", "aaaa")):
        got = toxicity.raw_kernel(toxicity.codes([a], 8), toxicity.codes([b], 8))[0]
        assert abs(got - brute_kernel(a, b)) < 1e-4


def test_toxic_sentences_equal_brute_force():
    """Documents' features by splitting, stripping and comparing in plain Python."""
    rng = random.Random(21)
    marks = ["idiot", "trash", "über"]
    bits = ["idiot", "id-iot", "idio", "TRASH!", "trashy", "(trash)", "i d i o t", "t.r-a.s h", "ÜBER", "übel", "ab", "a", "1 2 3", "\n", ". ", "? ", "x", "", "日本"]
    texts = [" ".join(rng.choice([*bits, prose(rng, 2)]) for _ in range(rng.randint(0, 14))) for _ in range(150)] + ["", None, "\n \n"]
    model = toxicity.Model(marks, np.array([2.0, 1.5, 1.0]), -1.2)

    def pairs(w, most):
        return {(a, b) for gap in range(1, most + 1) for a, b in zip(w, w[gap:], strict=False)}

    def value(word, mark):
        if 2 * len(pairs(word, 2) & pairs(mark, 1)) < len(pairs(mark, 1)):
            return 0.0
        v = brute_kernel(word, mark) / (max(brute_kernel(word, word), 1e-9) * brute_kernel(mark, mark)) ** 0.5
        return v if v >= toxicity.FLOOR else 0.0

    def forms(token):
        w = token.lower().strip(toxicity.EDGE)
        return [f for f in (w, "".join(filter(str.isalpha, w))) if len(f) >= 3]

    got = toxicity.Scorer(model).features(*texts_of(pa.array(texts, pa.string())))
    for text, row in zip(texts, got, strict=True):
        margins, n = [], len((text or "").split())
        sentences = re.split(r"(?<=[.!?])\s+|\s*\n\s*", text or "")
        at = 0
        spelled = {}
        for m in re.finditer(r"(?<![^\W_])[^\W_](?:[\s.\-_*]+[^\W_](?![^\W_])){2,}", text or ""):
            spelled.setdefault((text or "")[: m.start()], "".join(c for c in m[0] if c.isalnum()).lower())
        for s in sentences:
            begin = (text or "").index(s, at) if s else at
            at = begin + len(s)
            said = [f for t in s.split() for f in forms(t)] + [f for head, w in spelled.items() if begin <= len(head) < begin + len(s) for f in forms(w)]
            best = [max((value(f, m) for f in said), default=0.0) for m in marks]
            if any(best):
                margins.append(float(np.dot(best, model.weights)) + model.bias)
        count = sum(m > 0 for m in margins)
        want = [min(2, max(-2, max([model.bias, *margins]))), np.log1p(count), np.log1p(100 * count / max(n, 20)), 1]
        assert np.allclose(row, want, atol=1e-3), (text, row, want)


def test_toxicity_without_labels(spark):
    model = toxicity.train([], np.zeros(0))
    assert toxicity.score(documents(spark, ["a", None]), model).filter("score < 0.6").count() == 2


def test_licences(spark):
    notes = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "the license of the driver": None, "": None}
    texts = [f"é first line\n{n}\nlast line" for n in notes] + [None]
    got = {r.doc_id: r for r in licenses.scan(documents(spark, texts)).collect()}
    for k, (n, family) in enumerate(notes.items()):
        assert (got[k].family if k in got else None) == family
        if family:
            assert got[k].unit == 1 and texts[k][got[k].start : got[k].start + got[k].length] == n


def test_licences_wrapped_over_lines(spark):
    notes = {
        "// Licensed under the Apache License,\n// Version 2.0 (the same for all)": "Apache-2.0",
        " * Permission is hereby granted, free\n * of charge, to any person obtaining\n * a copy of this software": "MIT",
        "\n".join("licensed under the GNU General Public License version 3".split()): "GPL-3.0",
        "REM Redistribution and use in source\r\nREM and binary forms, with or without modification, are permitted": "BSD-3-Clause",
        "// Licensed under the Apache License,\n//\n// Version 2.0": None,
        "the public may use\nthe file of the license\nversion 2 of the text": None,
    }
    texts = [f"é on the\n\n{n}\n\nlast line" for n in notes]
    got = {}
    for r in licenses.scan(documents(spark, texts)).collect():
        got.setdefault(r.doc_id, []).append(r)
    for k, (n, family) in enumerate(notes.items()):
        assert [r.family for r in got.get(k, [])] == ([family] if family else [])
        for r in got.get(k, []):
            part = texts[k][r.start : r.start + r.length]
            assert part == n and texts[k][: r.start].count("\n") == r.unit


def test_licences_told_apart_and_denied(spark):
    notes = {
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later": ["GPL-3.0"],
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License": ["AGPL-3.0"],
        "This work is not licensed under the MIT License": [],
        "This work was never released under the MIT License": [],
        "SPDX-License-Identifier: MIT": ["MIT"],
        "// SPDX-License-Identifier: LGPL-3.0": ["LGPL-3.0"],
        "Licensed under the Kite License, version 2.0": [],
        "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": ["CC-BY-SA-4.0"],
    }
    found = {}
    for r in licenses.scan(documents(spark, [f"a line\n\n{n}\n\nlast" for n in notes])).collect():
        found.setdefault(r.doc_id, []).append(r.family)
    assert [found.get(k, []) for k in range(len(notes))] == list(notes.values())


def test_licence_confidences_are_about_right():
    for _, sure, right, n in licenses.reliability(licenses.train()):
        assert abs(sure - right) < 0.2 or n < 60


# --- pipeline


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    bench = [(k, prose(rng, 30)) for k in range(3)]
    texts = [prose(rng, 70) for _ in range(40)]
    line = prose(rng, 60)
    texts += [f"{prose(rng, 20)}\n{line}" for _ in range(4)] + [texts[0], texts[1] + " on"] + [prose(rng, 20) + " " + bench[0][1], "", None]
    texts += [f"{prose(rng, 20)} idiot {prose(rng, 20)}" for _ in range(12)]
    d = str(tmp_path)
    documents(spark, texts).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    toxic = set(range(len(texts) - 12, len(texts)))
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(len(texts)) if texts[i]], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, d).collect()}
    left = {i: t for i, t in enumerate(texts) if i not in toxic}
    comp = brute_components(list(left.values()), 5, 80)
    left = {i: t for (i, t), (_, c), own in zip(left.items(), comp, range(len(comp)), strict=True) if c == own}
    first = min(i for i, t in left.items() if t and line in t)
    left = {i: t if t is None or i == first or line not in t else t.replace("\n" + line, "") for i, t in left.items()}
    left = {i: t for i, t in left.items() if not brute_hits(t, bench)[1]}
    assert got.keys() == left.keys()
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
    assert all(got[i]["ids"] == theirs.encode_ordinary(t or "") and got[i].round_trip for i, t in left.items())


def test_null_text_bytes():
    data, at = texts_of(pa.array([None, "ab", ""]))
    assert at.tolist() == [0, 0, 2, 2] and data[:2].tobytes() == b"ab"
