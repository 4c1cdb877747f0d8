"""Source divergence, alignment of tokenizers and packing, against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict
from itertools import accumulate, product

import numpy as np
import pytest

from corpuscope.llm import align as A
from corpuscope.llm import cutting as C
from corpuscope.llm import divergence as D
from corpuscope.llm import packing as P
from corpuscope.llm.common import data_path

SCHEMA = "doc_id long, text string, lang string, source string, batch int, pairs string"
TEXTS = [
    "The quick brown fox, it's 12 o'clock.", "  two  spaces ", "x\n y\n", "", None, "漢字 かな 12３", "a ▁ b", "<s> <unk> <|endoftext|>", "é a ́b ÅÅ Å", "😀 😀x", "\x00 a \x85b", "a" * 3000,
    "word " * 3000, "The quick brown fox, it's 12 o'clock.", "İI ΣΑΣ ﬁ ÀÉ, ß.", "a\x0bb\x0cc\x1cd 'S 'll", "¼ ² ①", "gap here",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}", i, "z") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[0], (None, "no id", "de", None, 1, None)], SCHEMA)


def brute_alignment(own, text):
    raw = f" {text}".encode()
    a, b = own.a.encode(f" {text}", add_special_tokens=False).ids if text else [], own.b.encode(text) if text else []
    if not text or b"".join(own.bytes_a[i] for i in a) != raw or b"".join(own.bytes_b[i] for i in b) != raw:
        return [], [], [], []
    ends_a, ends_b = list(accumulate(len(own.bytes_a[i]) for i in a)), list(accumulate(len(own.bytes_b[i]) for i in b))
    links = [(x, y) for (i, x), (j, y) in product(enumerate(a), enumerate(b)) if (ends_a[i - 1] if i else 0) < ends_b[j] and (ends_b[j - 1] if j else 0) < ends_a[i]] if len(a) < 900 else None
    groups, last = [], 0
    for end in sorted(set(ends_a) & set(ends_b)):
        side = lambda ids, ends: ",".join(str(i) for i, e in zip(ids, ends) if last < e <= end)  # noqa: E731, B023
        groups.append(f"{side(a, ends_a)}|{side(b, ends_b)}")
        last = end
    return a, b, groups, links


def test_alignment_equals_brute_force(spark, docs):
    docs = docs.filter("length(text) < 3000 or text is null")
    own = A.aligner(data_path(A.A_FILE), data_path(A.B_FILE))
    rows = A.aligned(docs, groups=True).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    told = {k: brute_alignment(own, t) for k, t in texts.items()}
    assert len(rows) == docs.count()
    count = Counter(link for r in rows for link in told[r["doc_id"]][3])
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    for r in rows:
        a, b, groups, links = told[r["doc_id"]]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups"]) == (len(a), len(b), len(groups), len(links), ";".join(groups))
        assert (r["n_best"], r["count_sum"]) == (sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links))
        assert r["groups_sha256"] == (hashlib.sha256(r["groups"].encode()).hexdigest() if groups else "")
    assert [r["n_a"] for r in rows if texts[r["doc_id"]] in ("", None, "a ▁ b")] == [0, 0, 0]
    assert A.aligned(docs.limit(0)).count() == 0


def test_runs_are_encoded_as_whole_texts():
    own = A.Aligner(data_path(A.A_FILE), data_path(A.B_FILE))
    for text, at in zip(TEXTS, own.runs(TEXTS)):
        a, b, groups, _ = brute_alignment(own, text)
        assert own.sizes[at].sum(0).tolist()[:3] == [len(a), len(b), len(groups)] and ";".join(own.names[k] for k in at) == ";".join(groups)


def test_packing_keeps_every_id_once(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(data_path(P.VOCABULARY))
    want = Counter((r["doc_id"], tuple(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + (2,)) for r in docs.collect())
    for length in (4096, 64):
        rows = P.pack(docs, length=length, ids=True).collect()
        sequences, pieces = defaultdict(list), defaultdict(list)
        for r in rows:
            ids = np.frombuffer(bytes(r["ids"]), "<u4")
            assert len(ids) == r["length"] > 0 and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
            pieces[r["doc_id"], r["start"], r["doc_tokens"]].append(tuple(ids.tolist()))
        padding = 0
        for parts in sequences.values():
            parts.sort()
            assert [o for o, _ in parts] == [0, *accumulate(n for _, n in parts)][:-1]
            total = sum(n for _, n in parts)
            assert total <= length
            padding += 0 if total & (total - 1) == 0 else length - total
        assert padding <= sum(r["length"] for r in rows) / 50
        for (doc_id, whole), times in want.items():
            mine = sorted((s, ids) for (d, s, n), all_ids in pieces.items() for ids in all_ids if d == doc_id and n == len(whole))
            got = Counter()
            for s, ids in mine:
                got.update(range(s, s + len(ids)))
                assert ids == whole[s : s + len(ids)]
            assert set(got.values()) == {times} and len(got) == len(whole)
        narrow = sorted(tuple(x) for x in P.pack(docs, length=length).select("sequence_id", "offset", "length", "ids_crc32").collect())
        assert narrow == sorted((r["sequence_id"], r["offset"], r["length"], r["ids_crc32"]) for r in rows)
    assert P.pack(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        P.pack(docs, length=100)


def least_stocks(items, stock):
    """The fewest stocks for a handful of pieces, by trying all."""
    best = [len(items)]

    def place(k, rooms):
        if len(rooms) >= best[0] and k < len(items):
            return
        if k == len(items):
            best[0] = min(best[0], len(rooms))
            return
        for i in {r: i for i, r in enumerate(rooms) if r >= items[k]}.values():
            place(k + 1, [*rooms[:i], rooms[i] - items[k], *rooms[i + 1 :]])
        place(k + 1, [*rooms, stock - items[k]])

    place(0, [])
    return best[0]


def test_cutting_stock():
    for seed in range(20):
        rng = np.random.default_rng(seed)
        sizes = sorted(set(rng.integers(1, 30, 4).tolist()))
        counts = rng.integers(0, 4, len(sizes)).tolist()
        found = C.cut(sizes, counts, 30)
        used = [sum(p.get(i, 0) * t for p, t in found) for i in range(len(sizes))]
        assert used == counts and all(sum(sizes[i] * n for i, n in p.items()) <= 30 for p, _ in found)
        assert sum(t for _, t in found) <= least_stocks([s for s, n in zip(sizes, counts) for _ in range(n)][::-1], 30) + 1
    assert sum(t for _, t in C.cut([700, 900, 1000, 1380], [211, 395, 610, 97], 4096)) <= 312  # the bound is 310 2/3
    assert C.cut([], [], 10) == [] and sum(t for _, t in C.cut([2500, 1300], [1000, 777], 4096)) == 1000
    with pytest.raises(ValueError):
        C.cut([11], [1], 10)


def brute_audit(rows, least, ranks, scale):
    words = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c if c > "\x7f" or "a" <= c <= "z" else " " for c in t or "").split(" ")
    per, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        terms = [w for w in words(text) if w]
        groups[lang or ""].add(source or "")
        per[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        count = {s: {t: per[lang, s][t] for t in kept} for s in sources}
        whole = {t: sum(count[s][t] for s in sources) for t in kept}
        p = lambda c: {t: 1 + scale * (n + 2) // (sum(c.values()) + 2 * len(kept)) for t, n in c.items()}  # noqa: E731, B023
        f = lambda a, b: (a - b) ** 2 // (a + b)
        share, q = {s: p(c) for s, c in count.items()}, p(whole)
        for s in sources:
            pairs = sorted((-sum(f(share[s][t], share[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-f(share[s][t], q[t]), t.encode()) for t in kept if count[s][t] and share[s][t] > q[t])[:ranks]
            out += [(lang, s, part, item.decode(), -v, k) for part, found in (("pair", pairs), ("term", terms)) for k, (v, item) in enumerate(found, 1)]
    return sorted(out)


def test_divergence_equals_brute_force(spark, docs, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(["Aa", "b-c", "é", "DD1d", "漢", "x" * 50, "e"], int(rng.integers(0, 9)))), ["en", "fr", None][i % 3], f"s{rng.integers(0, 5)}" if i % 7 else None, 0, "") for i in range(150)]
    rows += [(900 + i, "once", "en", f"solo{i}", 0, "") for i in range(3)] + [(990, None, "none", "x", 0, ""), (991, "", "none", "y", 0, "")]
    table = spark.createDataFrame(rows + rows[:5], SCHEMA)
    got = D.audit(table, least=4, ranks=3)
    assert [f.dataType.simpleString() for f in got.schema] == ["string", "string", "string", "string", "bigint", "int"]
    want = brute_audit(rows + rows[:5], 4, 3, D.SCALE)
    assert sorted(map(tuple, got.collect())) == want
    monkeypatch.setattr(D, "PART_BYTES", 3)
    assert [t for part in D._parts("ab cé DD,e".encode()) for t in part] == [b"ab", "cé".encode(), b"dd", b"e"]
    assert D.audit(table.limit(0)).count() == 0 and sorted(map(tuple, D.audit(docs, least=2).collect())) == brute_audit([tuple(r) for r in docs.collect()], 2, 10, D.SCALE)


def test_key_is_drawn_where_none_is_named(spark, docs):
    from corpuscope.llm import pii

    drawn = pii.session_key(docs)
    assert len(drawn) == 64 and drawn == pii.session_key(docs)
    spark.conf.set(pii.KEY_CONF, "named")
    try:
        assert pii.session_key(docs) == "named"
    finally:
        spark.conf.unset(pii.KEY_CONF)


def test_shouted_words_are_ordinary(spark, sf_dir):
    from pyspark.sql import functions as F

    from corpuscope.llm import secrets as SC

    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = SC.train(SC.labelled_samples(docs, labels))
    told = spark.createDataFrame([("ERSCHSCHBERBERTZ",), ("ZUSAMMENARBEITEN",), ("Zx8Qp2Lm9Vt4Rk7Wn3Bd",)], "s string").select("s", (SC.log_ratio(F.col("s"), model) > SC.MARGIN).alias("random"))
    assert {r["s"]: r["random"] for r in told.collect()} == {"ERSCHSCHBERBERTZ": False, "ZUSAMMENARBEITEN": False, "Zx8Qp2Lm9Vt4Rk7Wn3Bd": True}
