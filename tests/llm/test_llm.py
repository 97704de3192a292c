import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataflow.llm import chat, classify, common, decontaminate, html, lm, media, mixing, packing, sharding, similarity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, v string"


def frame(spark, texts, start=0):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(start + i, t, "en" if i % 2 else None, "s", len(t or ""), 0.0, "x", None) for i, t in enumerate(texts)], DOCS)


def some_texts(n=60, seed=3):
    r = random.Random(seed)
    words = ["ab", "the", "quick", "é", "naïve", "fox", "Jumps", "over", "lazy", "dog,", "x1", "end."]
    out = [" ".join(r.choices(words, k=r.choice([1, 3, 8, 40, 200]))) for _ in range(n)]
    return [*out, out[0], out[1], None, "", "  \n ", "word", "w " * 20000, "z" * 50000]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, some_texts())


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


# ---- 1

def brute_windows(texts, items, k=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = {}
    for d, t in texts:
        w, hit, its = words(t), set(), set()
        for i, x in items:
            b = words(x)
            n = min(k, len(b))
            for s in range(len(b) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == b[s : s + n]:
                        hit |= set(range(p, p + n))
                        its.add(str(i))
        out[d] = (len(w), len(hit), len(its), hashlib.sha256(",".join(sorted(its)).encode()).hexdigest())
    return out


@pytest.mark.parametrize("most", [10**6, 0])
def test_decontamination(spark, most):
    r = random.Random(1)
    vocab = [f"w{i}" for i in range(30)] + ["É", "ß"]
    items = [(i, " ".join(r.choices(vocab, k=n))) for i, n in enumerate([12, 25, 3, 1, 0, 10])] + [(7, None), (8, "Tie tie-TIE"), (9, "tie tie tie")]
    texts = [" ".join(r.choices(vocab, k=50)) for _ in range(10)] + [f"before, {items[1][1].upper()}! after", f"{items[0][1]} {items[0][1]}", items[2][1], None, "", "Tie, tie... tie"]
    docs = frame(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: (x.n_words, x.n_hit, x.n_items, x.items_sha256) for x in decontaminate.scan(docs, bench, broadcast_bytes=most).collect()}
    want = brute_windows(enumerate(texts), [x for x in items])
    assert got == want
    kept = {x.doc_id for x in decontaminate.remove_documents(docs, bench, broadcast_bytes=most).collect()}
    assert kept == {d for d, x in want.items() if not x[1]}


def test_span_removal(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    out = decontaminate.remove_spans(frame(spark, ["start A b C d e f g h i j, stop", None, "a b c"]), bench)
    assert [x.text for x in out.orderBy("doc_id").collect()] == ["start , stop", None, "a b c"] and out.columns[1] == "text"


def test_decontamination_of_odd_rows(spark):
    """Null and repeated ids and texts: both ways give the rows of the plain version, in any order."""
    items = [(None, "a b c d e f g h i j k"), ("7", "x y"), ("7", None), ("7", "x y z"), (None, None), ("8", "a b c d e f g h i j")]
    rows = [(None, "say a b c d e f g h i j k"), (None, "x y"), (3, "clean"), (3, "so X Y z"), (3, "so X Y z"), (4, None)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id int, text string, spans string")
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id string, text string, h int")
    sha = lambda *x: hashlib.sha256(",".join(x).encode()).hexdigest()
    want = sorted([(None, 12, 11, 2, sha("8")), (None, 2, 2, 1, sha("7")), (3, 1, 0, 0, sha()), (3, 4, 3, 1, sha("7")), (3, 4, 3, 1, sha("7")), (4, 0, 0, 0, sha())], key=str)
    for most in (10**6, 0):
        got = [tuple(x)[:5] for x in decontaminate.scan(docs, bench, broadcast_bytes=most).collect()]
        assert sorted(got, key=str) == want
        kept = [tuple(x) for x in decontaminate.remove_documents(docs, bench, broadcast_bytes=most).collect()]
        assert sorted(kept, key=str) == [(3, "clean", "s"), (4, None, "s")]
        cut = [(x.doc_id, x.text) for x in decontaminate.remove_spans(docs, bench, broadcast_bytes=most).collect()]
        assert sorted(cut, key=str) == sorted([(None, "say "), (None, ""), (3, "clean"), (3, "so "), (3, "so "), (4, None)], key=str)


def test_decontamination_of_nothing(spark, docs, none):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.scan(none, bench).count() == 0
    assert decontaminate.scan(docs, bench).where("n_hit > 0").count() == 0


# ---- 2

def test_chat(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"turn {t} of {c}?\nmore") for c in range(12) for t in range(5)]
    df = spark.createDataFrame([(*r, "x", 1) for r in [*rows, rows[0], rows[0]]], "conv_id long, turn long, role string, text string, seq string, copies int")
    out = chat.format_chats(df).collect()
    assert len(out) == 60 and all(x.agrees for x in out)
    assert {(x.conv_id, x.turn): x.text for x in out} == {(r[0], r[1]): r[3] for r in rows}
    assert sum(x.copies for x in out) == 62
    assert chat.format_chats(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, 0, None, None, "", 0), (None, 0, "user", "b", "", 0), (1, None, "x", "", "", 0)], df.schema)
    assert chat.format_chats(odd).count() == 3


def brute_turns(lines, chain):
    """The likeliest path by plain recursion over whole paths of every mode."""
    seen = [chat.observe(x) for x in lines]
    best = None
    for m in range(chat.MODES):
        score = {}
        for i, (mark, form, shape, _) in enumerate(seen):
            symbol = 5 if mark == 4 else mark if mark < 3 and form == m else 3 if mark == 3 and m == chat.MODES - 2 else 4
            blank = i and seen[i - 1][2] == 0 and seen[i - 1][0] == 4
            new = {}
            for s in range(6):
                own = chain.marks[m, s, symbol] + chain.shapes[s, shape]
                new[s] = (chain.start[m, s] + own, (s,)) if not i else max(((v + chain.moves[m, int(blank), q, s] + own, (*path, s)) for q, (v, path) in score.items()), key=lambda x: x[0])
            score = new
        top = max(score.values(), key=lambda x: x[0])
        if best is None or top[0] > best[0]:
            best = (*top, m)
    return best


@pytest.mark.parametrize("seed", range(8))
def test_chat_viterbi_is_exact_over_blocks(seed):
    r = random.Random(seed)
    rng = np.random.default_rng(seed)
    chain = chat.Chain([rng.random(s) * 20 for s in chat.Chain.SHAPES])
    lines = [r.choice(["User: hi", "Kim: so?", "", "plain words", "- item", "[AI] yes", "what?", "### Human"]) for _ in range(60)]
    _, path, mode = brute_turns(lines, chain)
    for block in (3, 7, 60, 4096):
        got = list(chat.parse(zip(lines, range(60)), chain, block))
        want = [i for i, s in enumerate(path) if s < 3 or not i]
        assert [at for *_, at in got] == want and [chat.ROLES.index(x[0]) for x in got] == [path[i] % 3 for i in want]


def test_chat_of_missing_ambiguous_and_quoted_markers(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"line one of {t}.\nline two") for c in range(64) for t in range(4)]
    quoted = [(c, 4, "user", "he wrote:\n[User] not me\nUser: nor me\n### Human\nfine") for c in range(64)]
    after = [(c, 5, "assistant", "I see.") for c in range(64)]
    out = chat.format_chats(spark.createDataFrame(rows + quoted + after, "conv_id long, turn long, role string, text string")).collect()
    by = {}
    for x in out:
        by.setdefault(x.conv_id, []).append(x)
    style = {c: zlib.crc32(str(c).encode()) % len(chat.STYLES) for c in by}
    assert set(style.values()) == set(range(len(chat.STYLES)))
    for c, own in by.items():
        own.sort(key=lambda x: x.seq)
        assert [x.seq for x in own] == list(range(len(own)))
        if chat.STYLES[style[c]] not in ("{Role}: {text}", "[{Role}] {text}", "### {Role}\n{text}"):  # a quotation in its own form can't be told
            assert [x.turn for x in own] == list(range(6)) and all(x.agrees for x in own)
        # a later row is tied to its own place whatever came before
        assert [x for x in own if x.turn == 5][-1].agrees
    long = spark.createDataFrame([(1, t, ("user", "assistant")[t % 2], f"t{t}\nb") for t in range(5000)], "conv_id long, turn long, role string, text string")
    out = chat.format_chats(long).collect()
    assert sorted(x.seq for x in out) == list(range(5000)) and all(x.agrees and x.turn == x.seq for x in out)


# ---- 3

SMALL = (12, 13, 13, 13, 14, 14, 14)


def lm_rows(spark, texts, **how):
    return {x.doc_id: x for x in lm.Model(frame(spark, texts), bits=SMALL, **how).score().collect()}


def test_lm_base(spark):
    texts = some_texts()
    low = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())), b""]
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))}
    c = Counter(w for i, t in enumerate(texts) if not held[i] for w in low(t))
    n, v = c.total(), len(c)
    for frequent in (10**6, 3, 0):
        got = lm_rows(spark, texts, frequent=frequent)
        for i, t in enumerate(texts):
            own, x = low(t), got[i]
            assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held[i], len(own), sum(w in c for w in own), n)
            assert math.isclose(x.base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), rel_tol=1e-9)
            assert x.score <= 0 and math.isclose(x.bits_per_byte * sum(len(w) + 1 for w in own), -x.score * math.log2(10), rel_tol=1e-9)


def slow_cost(model, table, words, states):
    """Bits of tokens, one bit after the other, in plain Python."""
    m, code, base = model.mixer, model.code, model.slots.base.tolist()
    whole = (1 << 64) - 1

    def mix(h):
        h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9) & whole
        h = ((h ^ h >> 27) * 0x94D049BB133111EB) & whole
        return h ^ h >> 31

    a, b, out = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, []
    for word, state in zip(words, states):
        cost, kind, bytes_ = 0.0, int(model.kinds[state]), word + b" "
        for i, byte in enumerate(bytes_):
            last = lambda k, i=i: bytes_[i - k] if k <= i else 32
            keys = {k: mix((sum(last(j) << 8 * j for j in range(1, k + 1)) + k) * a & whole) for k in mixing.ORDERS}
            so_far = mix(sum((bytes_[j] + 1) * pow(common._P, j, 1 << 64) for j in range(i)) & whole ^ i * a & whole)
            beside = lambda h, x, f: mix((h + (x + 1) * f) & whole)
            ctx = [*keys.values(), *(beside(h, kind, b) for h in keys.values()), so_far, beside(so_far, kind, b), beside(so_far, state, a)]
            pair = last(1) * 256 + byte
            for j in range(code.at[pair], code.at[pair] + code.length[pair]):
                node, bit = int(code.node[j]), int(code.bit[j])
                u = [int(table[base[p] + ((h >> 32) + (node * 0x9E3779B1 & 0xFFFFFFFF)) % (1 << SMALL[p])]) for p, h in enumerate(ctx)]
                seen = [sum(x >= y for y in (1, 3, 16)) for x in (int(mixing.SIZE[v >> 8] + mixing.SIZE[v & 255]) for v in u)]
                w = m.w[seen[-3] * 16 + seen[-2] * 4 + seen[-1]]
                z = max(-14.0, min(14.0, sum(w[p] * float(m.stretch[p][v]) for p, v in enumerate(u)) + w[-1] * 0.3))
                at = (max(-8.0, min(8.0, z)) + 8) * (mixing.STEPS - 1) / 16
                k = min(int(at), mixing.STEPS - 2)
                p = 0.5 / (1 + math.exp(-z)) + 0.5 * (m.refined[node, k] * (1 - at + k) + m.refined[node, k + 1] * (at - k))
                p = max(1e-6, min(1 - 1e-6, p))
                cost -= math.log2(p if bit else 1 - p)
        out.append(cost)
    return out


def test_lm_scores_are_those_of_a_coder_bit_by_bit(spark, monkeypatch):
    tables = []
    keep = lm.Model._score_pairs
    monkeypatch.setattr(lm.Model, "_score_pairs", lambda self, pairs, table: tables.append(table) or keep(self, pairs, table))
    texts = some_texts(80)
    model = lm.Model(frame(spark, texts), bits=SMALL)
    rows = sorted((bytes(x.word), x.s, x.cost) for x in model.scored.collect() if len(x.word) < 200)
    slow = slow_cost(model, tables[0], [w for w, _, _ in rows], [s for _, s, _ in rows])
    assert np.allclose(slow, [c for *_, c in rows], rtol=1e-4)
    # the score of a text is the sum over its tokens after their states
    cost = {(w, s): c for w, s, c in rows}
    got = {x.doc_id: x.score for x in model.score().collect()}
    for i in (0, 1, 40, 83):
        state, total = 0, 0.0
        for w in [*(texts[i] or "").lower().encode().split(), b""]:
            total += cost[w, state]
            if 0 < len(w) <= lm.SHORT:
                h = int(lm._bucket(common.words(np.frombuffer(w, np.uint8), np.array([0, len(w)]), lm._GRAPH)[3])[0])
                state = int(model.guides[h]) if model.guides[h] >= 0 else state
        assert math.isclose(got[i], -total * math.log10(2), rel_tol=1e-9)


def test_lm_gives_probabilities(spark):
    """Over all bytes that may follow, the probabilities of a byte sum to one."""
    model = lm.Model(frame(spark, some_texts()), bits=SMALL)
    table = np.random.default_rng(0).integers(0, 1 << 16, int(model.slots.base[-1])).astype(np.uint16)
    words = pa.array([b"th" + bytes([b]) for b in range(256)], pa.binary())
    laid, cost = mixing.Laid(words, np.full(256, 1), model.kinds), np.zeros(256 * 4)
    for q in mixing.batches(laid):
        n, node, step, bit = model.code.spell(laid.pair[q])
        u = [np.take(table, model.slots.of(i, laid.context(i)[q], n, step)).astype(np.int64) for i in range(mixing.PREDICTORS)]
        np.add.at(cost, np.repeat(np.arange(len(laid.byte))[q], n), model.mixer.cost(u, bit, node))
    assert math.isclose(sum(2.0 ** -cost[2::4]), 1, rel_tol=1e-4)


def test_lm_of_held_out_rows(spark):
    """No count and no weight depends on them, and the mix is better than the base on them."""
    r = random.Random(5)
    words = [["".join(r.choices("abcdefghij"[4 * k :][:6], k=r.randint(1, 7))) for _ in range(80)] for k in (0, 1)]
    texts = [" ".join(r.choices(words[i % 2], weights=range(80, 0, -1), k=60)) for i in range(300)]
    every = lm_rows(spark, texts)
    assert sum(x.score for x in every.values() if x.held_out) > sum(x.base_score for x in every.values() if x.held_out)
    few = {x.doc_id: x.score for x in lm.Model(frame(spark, texts).where("crc32(cast(doc_id as string)) % 10 != 0"), bits=SMALL).score().collect()}
    assert few and all(math.isclose(every[i].score, x, rel_tol=1e-12) for i, x in few.items())


def test_lm_of_long_texts_and_words(spark, monkeypatch):
    texts = ["x" * 3000, "ab cd " * 5000, "the " + "y" * 2500 + " of it", "\u00e9" * 900 + " a", *some_texts(20)[:20]]
    whole = lm_rows(spark, texts)
    monkeypatch.setattr(lm, "STRETCH", 700)
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    cut = [(t.first + int(k), w) for t in lm.tokens(batch) for k, w in zip(t.text, t.words(np.arange(len(t.hash))).to_pylist())]
    assert cut == [(i, w) for i, t in enumerate(texts) for w in t.lower().encode().split()]
    guides = np.arange(lm.BUCKETS) % 5 - 1
    before = [(t.first + int(k), int(g)) for t in lm.tokens(batch, guides) for k, g in zip(t.text, t.before)]
    monkeypatch.setattr(lm, "STRETCH", 10**6)
    assert before == [(t.first + int(k), int(g)) for t in lm.tokens(batch, guides) for k, g in zip(t.text, t.before)]
    assert all(math.isfinite(x.score) for x in whole.values())


def test_lm_of_nothing(spark, none):
    assert lm.Model(none, bits=SMALL).score().count() == 0
    got = lm_rows(spark, [None, "", " \n", "a"])
    assert [got[i].n_tokens for i in range(4)] == [1, 1, 1, 2] and got[1].score == got[2].score
    held = lm.Model(frame(spark, ["a b", "b"], start=0).where("crc32(cast(doc_id as string)) % 10 = 0"), bits=SMALL).score().collect()
    assert all(x.train_tokens == 0 and x.base_score == 0 for x in held)
    ids = spark.createDataFrame([(None, "a b", "x"), (None, "a b", "y"), (7, "c", None), (7, "d", None)], "doc_id int, text string, score string")
    assert [x.held_out for x in lm.Model(ids, bits=SMALL).score().collect()].count(False) >= 2


def test_lm_count_tables_are_small_and_hold_all_predictors():
    assert max(8 * sum(1 << mixing.BITS[i] for i in group) for group in mixing.GROUPS) <= 64 << 20
    assert [i for group in mixing.GROUPS for i in group] == list(range(mixing.PREDICTORS))


def test_freed_memory_goes_back_when_a_task_ends():
    rss, last = lambda: int(open("/proc/self/statm").read().split()[1]) * 4 // 1024, []

    def run(batches):
        held = [np.ones(4000) for _ in range(6000)]
        last.append(np.ones(4000))  # lies above all others, so that the heap can't just end earlier
        yield from batches
        assert len(held) == 6000

    before = rss()
    assert list(common.trimmed(run)(iter([1, 2]))) == [1, 2]
    assert rss() - before < 60


# ---- 4

def test_warc(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "x\r\n\r\ny"), (4, "v", "x\r\n\r\ny"), (5, "w", "é"), (5, "w", "é"), (6, "w\r\nX: y", "p")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    path = warc.write(pages, common.scratch(spark, "warc"))
    read = warc.read(spark, path)
    got = {x.page_id: x for x in warc.fields(read).collect()}
    for i, _, h in rows:
        assert bytes(got[i].payload) == (h or "").encode()
        assert got[i].declared == "sha1:" + base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    assert {i: (x.record_type, x.refers_to) for i, x in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), 6: ("response", None)}
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    for x in read.collect():
        assert bytes(x.record).startswith(bytes(x.header)) and bytes(x.record).endswith(b"\r\n\r\n")
    small = warc.write(pages, common.scratch(spark, "warc"), revisit_from=3)
    assert {x.page_id for x in warc.fields(warc.read(spark, small)).where("record_type = 'revisit'").collect()} == {3}
    empty = warc.write(pages.limit(0), common.scratch(spark, "warc"))
    assert warc.read(spark, empty).count() == 0


def test_warc_of_null_ids_and_odd_urls(spark, tmp_path):
    rows = [(None, "http://a b", "p"), (None, "u\t\x7f", "p"), (None, None, "alone"), (3, "http://é/?q=%20", "p"), (None, "v", None)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id int, url string, html string, sha256 string, first_id int")
    read = warc.read(spark, warc.write(pages, common.scratch(spark, "warc")))
    got = warc.fields(read).collect()
    assert len(got) == 5 and sorted(bytes(x.payload) for x in got) == [b"", b"alone", b"p", b"p", b"p"]
    targets = {re.search(r"Target-URI: (.*?)\r", bytes(x.header).decode())[1] for x in got}
    assert targets == {"http://a%20b", "u%09%7F", "", "http://é/?q=%20", "v"}
    pages.drop("sha256", "first_id").write.parquet(f"{tmp_path}/pages.parquet")
    out = sorted((tuple(x) for x in warc.op4_warc(spark, str(tmp_path)).collect()), key=str)
    b32 = lambda t: base64.b32encode(hashlib.sha1(t).digest()).decode()
    want = [(3, 1, b32(b"p"), "response", None), (None, 0, b32(b""), "response", None), (None, 1, b32(b"p"), "revisit", 3), (None, 1, b32(b"p"), "revisit", 3), (None, 5, b32(b"alone"), "response", None)]
    assert out == sorted(want, key=str)


# ---- 5

def brute_components(texts, t=80, k=5):
    s = {}
    for d, x in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (x or "").encode().lower())
        s[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    up = {d: d for d in s}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(s)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(s[a] & s[b])
            if n and 100 * n >= t * len(s[a] | s[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(s[d]), root(d)) for d in s}


def near_texts(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh", k=3))
    passage = [word() for _ in range(60)]
    out = [None, "", " ", "one", "One", "one two", "a b c d e", "A b c d e"]
    for _ in range(12):
        base = [word() for _ in range(r.choice([6, 30, 120, 300]))]
        for _ in range(r.choice([1, 2, 6, 14])):
            w = list(base)
            for _ in range(int(len(w) * r.choice([0, 0.01, 0.02, 0.03, 0.05]))):
                w[r.randrange(len(w))] = word()
            at = r.randrange(len(w))
            out.append(" ".join([*w[:at], *passage, *w[at:]] if r.random() < 0.4 else w))
    # a chain: each linked with the next only
    base = [word() for _ in range(200)]
    for _ in range(12):
        for _ in range(2):
            base[r.randrange(200)] = word()
        out.append("\n".join(base))
    r.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_join(spark, seed):
    texts = near_texts(seed)
    docs = frame(spark, texts).repartition(3)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in similarity.join(docs, sketch_bits=12).collect()}
    want = brute_components(enumerate(texts))
    assert got == want
    kept = {x.doc_id for x in similarity.one_of_each(docs, sketch_bits=12).collect()}
    assert kept == {c for _, c in want.values()}


def test_jaccard_star_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "STAR", 2)
    texts = near_texts(7)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in similarity.join(frame(spark, texts), sketch_bits=4).collect()}
    assert got == brute_components(enumerate(texts))


@pytest.mark.parametrize("few", [0, 3])
def test_jaccard_stars_of_any_size(spark, monkeypatch, few):
    monkeypatch.setattr(similarity, "FEW", few)
    texts = near_texts(8)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in similarity.join(frame(spark, texts), sketch_bits=4).collect()}
    assert got == brute_components(enumerate(texts))


def test_jaccard_moves_no_sets_of_unlike_texts(spark, monkeypatch):
    r, told, written = random.Random(5), {}, common.written
    some = lambda n: ["".join(r.choices("abcdefgh", k=6)) for _ in range(n)]
    shared = [some(25) for _ in range(20)]
    base = some(80)
    texts = [" ".join([*some(40), *shared[i // 3], *some(40)]) for i in range(60)] + [" ".join(base), " ".join([*base[:-1], "x"])]

    def seen(df, name):
        out = written(df, name)
        told[name] = out.count()
        return out

    monkeypatch.setattr(common, "written", seen)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in similarity.join(frame(spark, texts), sketch_bits=1).collect()}
    assert got == brute_components(enumerate(texts)) and told["told"] == 1 < told["stars"]


def test_signatures_rule_out_no_link():
    r = np.random.default_rng(1)
    for n in (1, 5, 63, 64, 65, 100, 1000):
        x = r.integers(0, 1 << 63, n).astype(np.uint64)
        for less in range(0, n // 4 + 1, max(1, n // 40)):
            for more in (0, n // 10, n // 5):
                y = np.r_[x[less:], r.integers(0, 1 << 63, more).astype(np.uint64)]
                sig = similarity._signatures(np.repeat([0, 1], [len(x), len(y)]), np.r_[x, y], np.array([len(x), len(y)])).to_pylist()
                a, b = ((k, 8 * len(v), int.from_bytes(v, "little")) for k, v in zip((len(x), len(y)), sig))
                if 100 * (n - less) >= 80 * (n + more):
                    assert similarity._may_join(a, b, 80) and similarity._may_join(b, a, 80)


def test_jaccard_of_nothing(spark, none):
    assert similarity.join(none).count() == 0
    assert similarity.one_of_each(none).count() == 0
    twice = frame(spark, ["a b c d e f"]).unionByName(frame(spark, ["a b c d e f"]))
    assert [tuple(x)[0:2] for x in similarity.join(twice).collect()] == [(0, 2)]


# ---- 6

def test_media_round_trip(docs):
    for x, t in zip(media.features(docs, media=True).orderBy("doc_id").collect(), some_texts(), strict=True):
        raw = (t or "").encode()
        full = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        avi = media.Avi(bytes(x.media))
        assert avi.units()[: len(full)].tobytes() == full and x.payload_sha256 == hashlib.sha256(full).hexdigest()
        assert (x.n_bytes, x.payload_bytes, x.tail_crc32, x.media_bytes) == (len(raw), len(full), zlib.crc32(full[-16:]), len(x.media))
        assert x.shots[0].start == 0 and x.shots[-1].end == len(avi.frames)


def test_media_decoder_reads_the_stream():
    payload = bytes(range(256)) * 3
    data = media.encode(payload)
    at, n = media.Avi(data).frames[0]
    dc = media.decode_dc(data[at : at + n]).reshape(-1)
    assert np.where(dc >= 0, dc, dc + 255).astype(np.uint8).tobytes() == payload


def test_shots():
    units = np.r_[np.full(768 * 10, 97), np.full(768 * 10, 200)].astype(np.uint8)
    assert media.shots(units) == [(0, 10), (10, 20)]


# ---- 7

def test_sharding(spark, docs):
    store = sharding.Store(spark, common.scratch(spark, "store"), fanout=3, smallest=1000)
    for k in range(7):
        store.append(docs.where(F.col("doc_id") % 7 == k))
    assert store.version() == 7 and len(store.shards()) == 7
    store.compact()
    assert len(store.shards()) < 7 and store.read().count() == docs.count() and store.read(3).count() < docs.count()
    assert sorted(x.doc_id for x in store.read().collect()) == sorted(x.doc_id for x in docs.collect())
    with pytest.raises(sharding.Conflict):
        store.commit(store.shards(), store.version() - 1)
    # of two writers with one base, the later one commits to the newer version
    v, n, behind = store.version(), len(store.shards()), store.version
    last = iter([v, v - 1])
    store.version = lambda: next(last, None) or behind()
    assert store.append(docs.limit(2)) == v + 1 and len(store.shards()) == n + 1
    assert store.commit([x for x in store.shards() if x in store.shards(v)], v + 1) == v + 2
    # what another writer has written and not yet committed stays, unless it is old
    waiting = store._write(docs.limit(3), 99)
    assert store.vacuum() >= 7 and store.read().count() == docs.count()
    assert store.commit([*store.shards(), waiting], store.version()) and store.read().count() == docs.count() + 3
    store._write(docs.limit(3), 99)
    assert store.vacuum(grace=-60) == 1 and store.vacuum(grace=-60) == 0
    assert store.read().columns == docs.columns and set(store.read(shard="at").columns) == {*docs.columns, "at"}
    with pytest.raises(ValueError):
        store.read(shard="text")
    v, n = store.version(), len(store.shards())
    assert store.append(docs.limit(0)) == v and len(store.shards()) == n


def test_sharding_of_an_empty_table(spark, none, tmp_path):
    none.write.parquet(f"{tmp_path}/documents.parquet")
    out = sharding.op7_sharding(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["doc_id", "shard_arrival", "n_bytes", "text_crc32", "live_shards", "version"]


# ---- 8

P = "This is a paragraph of the article, long enough to count. It has two sentences."


A = "<article><h1>Title</h1><p>{}</p></article><footer>foot, of a page.</footer>".format


@pytest.mark.parametrize(
    "source, want",
    [
        (None, ""),
        ("", ""),
        ("plain", "plain"),
        (f"<body><nav><a>Home</a></nav><article><h1>Title</h1><p>{P}<p>Short.</article><footer>foot</footer>", f"Title {P} Short."),
        (f"<div class=menu>m</div><div id='content'><p>{P}</p><p>a &amp; b&nbsp;c<br>d</p><p>{P}</p></div><div class='sidebar'><p>{P}</p></div>", f"{P} a & b c d {P}"),
        (f"<main><p>{P}</p><div class='ad-box'>Buy</div><form><input><label>Name</label></form><p>{P}</p><section id=comments><p>Nice one, thanks for this.</p></section></main>", f"{P} {P}"),
        (f"<article><header><h1>T</h1></header><p>x<b>y</b>z {P}</p><script>var a='</p>';</script><style>p{{}}</style><!-- no --><aside>s</aside></article>", f"T xyz {P}"),
        (f"<div role=dialog>Cookies?</div><article class='has-sidebar'><ul><li>one<li>two</ul><p>{P}</article>", f"one two {P}"),
        # attributes that only look like marks
        (A(f"{P}</p><p class='overflow-hidden'>{P}"), f"Title {P} {P}"),
        (A(f"{P}</p><p title='the hidden valley'>{P}"), f"Title {P} {P}"),
        (A(f"{P}</p><p data-id='comment-policy'>{P}"), f"Title {P} {P}"),
        (A(f"{P}</p><p hidden>{P}</p><p style='Display: none'>{P}"), f"Title {P}"),
        # blocks that no list names
        (A(f"{P}</p><div class=x7><a href=1>More about this, and that.</a> <a href=2>Other things, too.</a></div><p>{P}"), f"Title {P} {P}"),
        (A(f"{P}</p><div class=q>Great shoes, half price!</div><p>{P}"), f"Title {P} {P}"),
        (f"<div class=top>Our shop. Since 1990.</div><div class=m><div>{P} {P}</div><div>{P}</div></div><div class=z>Call us, now!</div>", f"{P} {P} {P}"),
        (A(f"{P} <math><mi>x</mi><mo>=</mo><mn>1</mn></math>"), f"Title {P} x=1"),
        (f'<p title="open>{P}</p><p>{P}</p>', f"{P} {P}"),
    ],
)
def test_main_text(source, want):
    assert html.extract(source) == want


def brute_main_text(blocks):
    """blocks: (container and tag, class, text). Path ratios by plain sums over a page without links or landmarks."""
    path = [(tuple(b[0]), b[1]) for b in blocks]
    prose = [b[0][-1] in ("p", "h2", "li") for b in blocks]
    size = [len(b[2]) * (1 if ok else 0.1) for b, ok in zip(blocks, prose)]
    marks = [sum(c in ".,!?" for c in b[2]) for b in blocks]
    mean = lambda v, i: sum(x for x, q in zip(v, path) if q == path[i]) / path.count(path[i])
    at = range(len(blocks))
    lens, puncts = [mean(size, i) for i in at], [mean(marks, i) for i in at]
    g = [math.exp(-(k**2) / 2) for k in range(-3, 4)]
    near = lambda v, i: sum(w * v[min(max(i + k, 0), len(v) - 1)] for w, k in zip(g, range(-3, 4))) / sum(g)
    smooth = [math.sqrt(near(lens, i) * (1 + near(puncts, i))) for i in at]
    fused = []
    for i in at:
        own = math.sqrt(lens[i] * (1 + puncts[i]))
        fused.append(math.sqrt(own * mean(smooth, i)) * math.log(2 + mean(size, i) * path.count(path[i]) / 100))
    best = fused.index(max(fused))
    if not prose[best]:  # each piece of bare text is an element of its own
        return None
    held = [blocks[i][0][:-1] for i in at if path[i] == path[best]]
    root = held[0]
    while any(h[: len(root)] != root for h in held):
        root = root[:-1]
    need = [(0.001 if prose[i] else 0.35) if blocks[i][0][: len(root)] == root else 0.5 for i in at]
    return " ".join(b[2] for b, f, n in zip(blocks, fused, need) if f >= n * max(fused))


@pytest.mark.parametrize("seed", range(30))
def test_main_text_by_path_ratios(seed):
    r = random.Random(seed)
    blocks, page = [], []
    for k in range(r.randint(2, 5)):
        box = f"x-{k}"  # an element of its own
        page.append(f"<{box}>")
        for _ in range(r.randint(1, 6)):
            tag, kind = r.choice(["p", "p", "h2", "div", "li"]), r.choice(["", "", "k"])
            text = " ".join("".join(r.choices("abcde", k=r.randint(1, 8))) + r.choice(["", "", ",", "."]) for _ in range(r.choice([1, 4, 30])))
            page.append(f"<{tag} class='{kind}'>{text}</{tag}>")
            blocks.append(((box, tag), kind, text))
        page.append(f"</{box}>")
    want = brute_main_text(blocks)
    if want is not None:
        assert html.extract("".join(page)) == want


def test_main_text_rests_on_the_ratios(monkeypatch):
    page = f"<div class=top><p>Our shop.</p></div><article><h1>T, of it.</h1><p>{P}</p></article><div class=end>Call us, now!</div>"
    assert html.extract(page) == f"T, of it. {P}"
    monkeypatch.setattr(html, "ratios", lambda length, punct, path, sigma=1.0: np.ones(len(length)))
    assert html.extract(page) != f"T, of it. {P}"


def test_main_text_table(spark):
    pages = spark.createDataFrame([(1, "u", f"<article><p>{P}</p></article>", 1, "x"), (2, None, None, 2, None), (2, None, None, 2, None)], "page_id long, url string, html string, n_chars int, text string")
    got = [(x.page_id, x.text, x.n_chars) for x in html.main_text(pages).orderBy("page_id").collect()]
    assert got == [(1, P, len(P)), (2, "", 0), (2, "", 0)]
    assert html.main_text(pages.limit(0)).count() == 0
    assert html.extract("<div>" * 3000 + P) == P
    assert html.extract(f"<article><p>{'word, ' * 200_000}</p></article>") == ("word, " * 200_000).strip()


# ---- 9

def test_packing(spark, docs):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    tok = Tokenizer.from_file(path)
    out = packing.pack(packing.pieces(docs, path), part=20).collect()
    ids = {d: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for d, t in enumerate(some_texts())}
    by = {}
    for x in out:
        own = ids[x.doc_id][x.start : x.start + x.length]
        assert len(own) == x.length <= 2048 and x.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        by.setdefault(x.sequence_id, []).append((x.offset, x.length))
    assert sum(x.length for x in out) == sum(map(len, ids.values()))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 2048
    assert len(by) == packing.lower_bound(np.bincount([x.length for x in out], minlength=2049))
    for d, x in ids.items():
        pieces = sorted((p.piece, p.length) for p in out if p.doc_id == d)
        assert [n for _, n in pieces][1:] == [2048] * (len(pieces) - 1) and (len(pieces) == 1) == (len(x) <= 2048)


def test_packing_of_nothing(none):
    assert packing.pack(packing.pieces(none, packing.tokenizer_path())).count() == 0


def test_encoder_gives_the_librarys_ids():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    tok, e = Tokenizer.from_file(path), packing.Encoder(path)
    odd = ["a  b", " lead", "trail ", "", "\n\n", "don't we'll\t x", "é  è\r\n z", "a <|endoftext|> b", "<|endoftext|><|endoftext|>x", "日本 語", "c²½ “x”", "\u0085\x1c a", "İ ǅ ʰ", "🙂 ok"]
    odd += ["x" + " " * n + "y" for n in (999, 1000, 1001)] + [" " * 2_000_000, "\n" * 2_000_000, "ab" * 500_000, "\u00a0 " * 50_000]
    assert e.encode(odd) == [np.array(tok.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in odd]
    assert np.frombuffer(e.encode(["a <|endoftext|> b"])[0], "<u4").tolist() == [64, 220, 50256, 275]


def test_packing_of_null_and_repeated_ids(spark):
    rows = spark.createDataFrame([(None, "a b", "x", "y")] * 30 + [(5, "c", None, "y")] * 30 + [(5, None, "x", "y")], "doc_id long, text string, length string, piece string")
    out = packing.pack(packing.pieces(rows, packing.tokenizer_path()), part=40).collect()
    assert len(out) == 61 and sum(x.length for x in out) == 30 * 3 + 30 * 2 + 1
    for q in {x.sequence_id for x in out}:
        own = sorted((x.offset, x.length) for x in out if x.sequence_id == q)
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]]


@pytest.mark.parametrize("seed", range(5))
def test_bounds(seed):
    r = np.random.default_rng(seed)
    lengths = r.integers(1, 101, 60)
    bins = packing.best_fit(lengths, 100)
    assert np.bincount(bins, lengths).max() <= 100
    assert -(-lengths.sum() // 100) <= packing.lower_bound(np.bincount(lengths, minlength=101)) <= bins.max() + 1
    assert packing.lower_bound(np.bincount([51] * 7, minlength=101)) == 7


# ---- 10

def labelled(spark, n=600):
    r = random.Random(5)
    good = lambda: " ".join(r.choices("the cat sat on a mat and then it ran away from us".split(), k=40)).capitalize() + "."
    bad = [lambda: "BUY NOW!! " * 20, lambda: "x | y | z " * 15, lambda: "spam " * 50, lambda: "a### b$$$ c*** " * 12]
    y = [int(r.random() < 0.8) for _ in range(n)]
    return [good() if k else r.choice(bad)() for k in y], y


def test_quality(spark):
    texts, y = labelled(spark)
    docs = frame(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(i, v, 0) for i, v in enumerate(y) if i % 2] + [(0, None, 0)], "doc_id long, quality int, toxic int")
    model = classify.fit(classify.features(docs), labels)
    s = {x.doc_id: x.score for x in classify.scored(classify.features(docs), model).collect()}
    assert np.mean([(s[i] >= 0.5) == v for i, v in enumerate(y)]) > 0.97 and len(s) == len(texts) + 2
    kept = classify.keep_good(docs, labels)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {i for i, v in s.items() if v >= 0.5}
    positive = classify.fit(classify.features(docs), labels.where("quality = 1"))
    assert 0.5 < positive.prior < 0.99


def test_quality_of_capped_samples(spark):
    texts, y = labelled(spark)
    labels = spark.createDataFrame([(i, v) for i, v in enumerate(y)], "doc_id long, quality int")
    own = [v for i, v in enumerate(y) if zlib.crc32(str(i).encode()) % 3 != 1]
    feats = common.written(classify.features(frame(spark, texts)), "features")
    assert classify.fit(feats, labels, sample=50).prior == pytest.approx(np.mean(own))


def test_quality_line_at_the_rates_of_all_rows():
    # the two kinds overlap; two samples of 1,000 stand for 9,000 and 1,000 rows
    rng = np.random.default_rng(3)
    kind = lambda n, at: np.clip(rng.normal(at, 1, (n, classify.N_FEATURES)) * (np.arange(classify.N_FEATURES) == 0), -3, 3)
    pos, neg = kind(1000, 0.5), kind(1000, -0.5)
    for unl in (np.concatenate([kind(9000, 0.5), kind(1000, -0.5)]), np.zeros((0, classify.N_FEATURES))):
        m = classify.learn(pos, neg, unl, steps=300, counts=(9000, 1000))
        assert 0.9 * m.score(pos).mean() + 0.1 * m.score(neg).mean() == pytest.approx(0.9, abs=0.02)


def test_quality_without_labels(spark, docs, none):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert classify.fit(classify.features(docs), labels) is None
    assert {x.score for x in classify.scored(classify.features(docs), None).collect()} == {0.5}
    assert classify.keep_good(none, labels).count() == 0


# ---- pipeline

def test_pipeline_stage_by_stage(spark, tmp_path):
    """Every stage's rows are those of its plain version on what the stage before kept."""
    import corpus_pipeline

    r = random.Random(11)
    words = ["".join(r.choices("abcdefghijklmno", k=r.randint(2, 9))) for _ in range(300)]
    good = [" ".join(r.choices(words, k=r.randint(30, 120))).capitalize() + "." for _ in range(60)]
    bad = ["".join(r.choices("#!$%&*0123456789 ", k=r.randint(40, 400))) for _ in range(20)]
    item = " ".join(r.choices(words, k=14))
    near = [g + " end" for g in good[:8]] + good[8:12] + good[8:10]
    texts = [*good, *bad, *near, f"{good[20]} {item} {good[21]}", None, "", "one two"]
    docs = spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(2)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(60 > i or i >= 80), 0) for i in range(len(texts)) if i % 5], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, own = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, str(tmp_path)), name)
        own[name] = docs.collect()
    kept = {n: {x.doc_id for x in rows} for n, rows in own.items()}
    model = classify.fit(classify.features(spark.read.parquet(f"{tmp_path}/documents.parquet")), spark.read.parquet(f"{tmp_path}/labels.parquet"))

    def score(t):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        return float(model.score(classify.text_features(raw, np.array([0, len(raw)])))[0])

    assert kept["quality_classifier"] == {i for i, t in enumerate(texts) if score(t) >= 0.5}
    assert set(range(60)) <= kept["quality_classifier"] and not kept["quality_classifier"] & set(range(60, 80))
    first = brute_components((i, texts[i]) for i in sorted(kept["quality_classifier"]))
    assert kept["ngram_jaccard_join"] == {i for i, (_, c) in first.items() if i == c}
    hit = brute_windows([(i, texts[i]) for i in kept["ngram_jaccard_join"]], [(1, item)])
    assert kept["benchmark_decontamination"] == {i for i, x in hit.items() if not x[1]} != kept["ngram_jaccard_join"]
    assert kept["best_fit_packing"] == kept["benchmark_decontamination"]
    assert [x.asDict() for x in sorted(own["benchmark_decontamination"], key=lambda x: x.doc_id)][0].keys() == {"doc_id", "text", "lang", "source", "n_chars"}
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    plain = lambda rows: sorted((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in rows)
    assert plain(whole) == plain(own["best_fit_packing"])
    empty = tmp_path / "empty"
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{t}.parquet").limit(0).write.parquet(f"{empty}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
