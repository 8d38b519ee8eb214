"""BPE, SimHash, line dedup, mixing, toxicity and quotation linking against brute force, with the awkward cases."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from rowproof.llm import bpe, components, linededup, mixing, quotes, simhash, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.json")
DATA = "/root/testdata/sf0.001"
AWKWARD = ["", None, " ", "\n\n", "a", "a" * 5000, "the the the the", "Ünïcödé ñ 中文 \U0001f600", "x<|endoftext|>y", "it's  we'll\t12 ½ Ⅷ", " \x85\x1c"]


def docs(spark, texts, **columns):
    rows = [(i, t, "en", f"s{i % 2}", 0, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_tokens string")


# ---- BPE


def test_bpe_equals_the_library(spark):
    rng = random.Random(1)
    bits = ["a", "b", "aa", "the", "ing", " ", "  ", "\n", "é", "ß", "中", "\U0001f600", "1", "½", "'s", "'ll", "<|endoftext|>", "\x85", "\xa0", "_", "Z", "́"]
    texts = AWKWARD + ["".join(rng.choice(bits) for _ in range(rng.randrange(50))) for _ in range(300)]
    t = Tokenizer.from_file(PATH)
    got = {r.doc_id: r for r in bpe.digests(docs(spark, texts), PATH).collect()}
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids), text
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_restarts_its_word_store(spark, monkeypatch):
    v = bpe.Vocabulary(open(PATH).read())
    assert v.encode_words([]) == [] and v.encode_words([b"ab", b"a"])[1] == v.encode_words([b"a"])[0]
    assert bpe.digests(docs(spark, ["x"]).where("false"), PATH).count() == 0


# ---- SimHash


def brute_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(fps, radius):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_simhash_equals_brute_force(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) for _ in range(120)) for _ in range(12)]
    near = [b[: -len(b.split()[-1])] + "changed" for b in base]
    texts = AWKWARD + base + near + [b.upper() for b in base] + base[:3] * 10
    fps = [brute_fingerprint(t) for t in texts]
    want = brute_groups(fps, 4)
    for shard_rows in (512, 2):  # two rows a tree: shards are cut and every pair of trees meets
        got = sorted(simhash.groups(docs(spark, texts), shard_rows=shard_rows).collect(), key=lambda r: r.doc_id)
        assert [r.fingerprint for r in got] == [f"{f:016x}" for f in fps]
        assert [r.component_id for r in got] == want


def test_close_fingerprints_meet_at_every_distance(spark):
    rng = random.Random(4)
    fps = []
    for _ in range(60):
        x = rng.getrandbits(64)
        fps += [x, x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 7)))]
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.close_edges(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    assert all(1 <= ((e.u ^ e.v) & (1 << 64) - 1).bit_count() <= 4 for e in edges)
    close = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 4]
    found = {frozenset(((e.u) % (1 << 64), e.v % (1 << 64))) for e in edges}
    assert {frozenset(p) for p in close} == found


def test_bk_tree_and_empty_input(spark):
    values = [random.Random(i).getrandbits(16) for i in range(200)]
    tree = simhash.BkTree(values)
    for q in values[:20]:
        assert sorted(tree.within(q, 3)) == sorted({v for v in values if (v ^ q).bit_count() <= 3})
    assert list(simhash.BkTree().within(1, 3)) == []
    assert simhash.groups(docs(spark, ["x"]).where("false")).count() == 0


def test_deduplicated_keeps_one_of_each_group_and_rows_without_id(spark):
    long = " ".join(f"word{i}" for i in range(60))
    d = docs(spark, [long, long, "quite another text with its own words here", long.upper()])
    d = d.unionByName(d.where("doc_id = 2")).unionByName(d.where("doc_id = 1").selectExpr("cast(null as long) doc_id", "text", "lang", "source", "n_chars", "n_tokens"))
    kept = simhash.deduplicated(d)
    assert kept.columns == d.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 0), (False, 2), (True, None)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 101), (101, 100), (7, 7), (50, None)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, 101: 100}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_of_hubs(spark, monkeypatch):
    """Stars whose hubs are broadcast give what they give without: two hubs with a common leaf, a hub that is no root, chains."""
    edges = [(1000, i) for i in range(1, 200)] + [(5000, i) for i in range(5001, 5100)] + [(199, 5050), (7000, 7001), (7001, 7002)]
    frame = spark.createDataFrame(edges, "u long, v long")
    want = {**{i: 1 for i in range(2, 200)}, **{i: 1 for i in (1000, 5000, *range(5001, 5100))}, 7001: 7000, 7002: 7000}
    for rows in (10, 1_000):
        monkeypatch.setattr(components, "HUB_ROWS", rows)
        assert {r.node: r.root for r in components.components(frame).collect()} == want


def test_looked_up_deals_hubs(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB_ROWS", 5)
    rows = spark.createDataFrame([(k, str(i)) for k, n in (("a", 50), ("b", 3)) for i in range(n)], "k string, o string")
    groups = spark.createDataFrame([("a", 1, 50), ("b", 2, 3), ("c", 3, 9)], "k string, v long, n long")
    got = components.looked_up(rows, groups, "k", "v", "o", 53).collect()
    assert sorted(map(tuple, got)) == sorted((r.k, r.o, 1 if r.k == "a" else 2) for r in rows.collect())


# ---- line dedup


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(3)
    texts = ["\n".join([rng.choice(["MENU", "menu", f"own {i}"]), "", f"own {i}.2", *(["  FOOTER "] if i % 3 else [])]) for i in range(40)] + [None, "", "MENU", "MENU\nMENU"]
    d = docs(spark, texts)
    got = {r.doc_id: r for r in linededup.cleaned(d, "source", "text", ratio=0.2, min_pages=3).collect()}
    pages, seen = {}, {}
    for i, t in enumerate(texts):
        pages[i % 2] = pages.get(i % 2, 0) + 1
        for line in {x.strip(" \t\r") for x in (t or "").split("\n")} - {""}:
            seen[i % 2, line] = seen.get((i % 2, line), 0) + 1
    for i, t in enumerate(texts):
        keep = lambda x: not (seen.get((i % 2, x.strip(" \t\r")), 0) >= 3 and seen[i % 2, x.strip(" \t\r")] > 0.2 * pages[i % 2])  # noqa: E731, B023
        lines = t.split("\n") if t is not None else []
        assert got[i].text == (None if t is None else "\n".join(filter(keep, lines)))
        assert (got[i].n_lines, got[i].n_dropped) == (len(lines), sum(not keep(x) for x in lines))
    assert got[0].lang == "en"


def test_line_dedup_null_host_and_empty(spark):
    d = spark.createDataFrame([(i, None, "same\nown %d" % i) for i in range(6)], "doc_id long, source string, text string")
    assert {r.text for r in linededup.cleaned(d, "source", "text").collect()} == {f"own {i}" for i in range(6)}
    assert linededup.cleaned(d.where("false"), "source", "text").count() == 0


# ---- mixing


def test_raked_cells_meet_all_marginals(spark):
    rng = random.Random(7)
    cells = [(s, x, t, rng.randrange(1, 1000)) for s in ("a", "b", "c") for x in ("en", "de") for t in ("note", "table")]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    goals = {"source": {"a": 0.2, "b": 0.3, "c": 0.5}, "lang": {"en": 0.6, "de": 0.4}, "topic": {"note": 0.5, "table": 0.5}}
    targets = {d: spark.createDataFrame(list(g.items()), "value string, share double") for d, g in goals.items()}
    got = mixing.rake(df, targets).collect()
    total = sum(c[3] for c in cells)
    for d, g in goals.items():
        for v, share in g.items():
            assert abs(sum(r.weight for r in got if r[d] == v) / total - share) < 1e-8


def test_sampling_is_calibrated_and_handles_awkward_rows(spark):
    d = docs(spark, [f"text {i} " * (1 + i % 7) for i in range(3000)] + AWKWARD)
    d = d.unionByName(d.limit(1).selectExpr("cast(null as long) doc_id", "text", "cast(null as string) lang", "cast(null as string) source", "n_chars", "n_tokens"))
    rows = mixing.report(d).collect()
    assert len(rows) == d.count() and all(0 <= r.p <= 1 for r in rows)
    expected = sum(r.p for r in rows)
    assert abs(sum(r.kept for r in rows) - expected) < 4 * expected**0.5
    assert mixing.sampled(d).columns == d.columns
    assert mixing.report(d.where("false")).count() == 0


# ---- toxicity


def test_swap_penalty_frees_identity_terms():
    """A corpus in which a group's name stands in most toxic sentences and in few others."""
    rng = np.random.default_rng(1)
    words = ["muslim", "christian", "idiot", "tree", "river", "stone"]
    number = {w: i for i, w in enumerate(words)}
    rows, pairs, y = [], [], []
    for _ in range(600):
        toxic = rng.random() < 0.5
        text = {words[3 + rng.integers(3)]}
        if toxic and rng.random() < 0.7:
            text.add("idiot")
        if rng.random() < (0.9 if toxic else 0.1):
            text.add("muslim")
        rows.append(sorted(number[w] for w in text))
        pairs += [(rows[-1], sorted(number[w] for w in other(text))) for other in (toxicity.swapped, toxicity.without_terms)]
        y.append(int(toxic))
    neutral = lambda w, b: 1 / (1 + np.exp(-(w[number["muslim"]] + w[number["tree"]] + b)))
    plain = neutral(*toxicity.fit(rows, pairs, np.array(y), len(words), swap_penalty=0.0))
    free_w, free_b = toxicity.fit(rows, pairs, np.array(y), len(words), swap_penalty=50.0)
    assert plain > 0.6 > 0.5 > neutral(free_w, free_b)
    assert abs(free_w[number["muslim"]] - free_w[number["christian"]]) < 0.2 and free_w[number["idiot"]] > 1


def test_toxicity_held_out_accuracy_and_cases(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    more = docs(spark, AWKWARD).selectExpr("doc_id + 1000000 as doc_id", "text", "lang", "source", "n_chars").unionByName(d.limit(1).selectExpr("cast(null as long) doc_id", "text", "lang", "source", "n_chars"))
    rows = toxicity.classified(d.unionByName(more), labels).collect()
    assert len(rows) == d.count() + len(AWKWARD) + 1 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    known = {r.doc_id: r.toxic for r in labels.collect()}
    judged = [(known[r.doc_id], r.predicted) for r in rows if r.doc_id in known and r.held_out]
    assert sum(a == b for a, b in judged) / len(judged) > 0.93


def test_toxicity_without_labels(spark):
    d = docs(spark, ["a", None])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.classified(d, none).collect()} == {0.0}


# ---- quotes


def test_quotes_are_taken_out_and_linked(spark):
    rows = [
        (1, 0, "user", "First point. Second point!\nThird line."),
        (1, 1, "assistant", "On turn 0, user wrote:\n> First point. Second\n> point!\n\nI agree."),
        (1, 2, "user", "> I agree.\n>> Second point!\nGood."),
        (1, 3, "user", "> Third line.\nElsewhere."),
        (1, 4, "user", "> never said\nAlone."),
        (1, 5, None, None),
        (2, 0, "user", "First point. Second point!"),
        (None, 0, "user", "> First point.\nOwn."),
        (1, None, "user", "> First point.\nNo turn."),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumnRenamed("x", "x")
    got = {(r.conv_id, r.turn): r for r in quotes.conversations(df).collect()}
    assert len(got) == len(rows)
    text = {k: r.text for k, r in got.items()}
    assert text[1, 1] == "I agree." and text[1, 2] == "Good." and text[1, 0] == rows[0][3] and text[1, 5] == "" and text[None, 0] == "Own."
    assert {k: r.reply_to for k, r in got.items() if r.reply_to is not None} == {(1, 1): 0, (1, 2): 1, (1, 3): 0}
    assert (got[1, 2].root, got[1, 2].depth, got[1, 2].n_quotes, got[1, 2].n_linked) == (0, 2, 2, 2)
    assert (got[1, 4].root, got[1, 4].depth, got[1, 4].n_linked) == (4, 0, 0)
    order = [r.turn for r in sorted((r for r in got.values() if r.conv_id == 1), key=lambda r: r.position)]
    assert order == [None, 0, 1, 3, 2, 4, 5] and [r.position for r in got.values() if r.conv_id == 2] == [0]


def test_mail_form_is_undone(spark):
    c = spark.read.parquet(f"{DATA}/conversations.parquet")
    back = {(r.conv_id, r.turn): r for r in quotes.conversations(quotes.as_mail(c)).collect()}
    for r in c.collect():
        assert back[r.conv_id, r.turn].text == r.text
        assert back[r.conv_id, r.turn].depth == r.turn == back[r.conv_id, r.turn].position
    assert quotes.conversations(quotes.as_mail(c.where("false"))).count() == 0


def test_long_reply_chain(spark):
    rows = [(1, i, "u", f"> message number {i - 1}.\nmessage number {i}.") for i in range(70)]
    got = quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert all(r.depth == r.turn == r.position and r.root == 0 for r in got)


def test_odd_conversations_equal_sql(spark):
    """Quotes within the table's own texts, whole and partial, repeated rows and sentences, nulls, unlinked and forward quotes, three levels."""
    import duckdb

    rows = [
        (1, 0, "a", "Yes. Thanks. A."), (1, 1, "b", "Yes. Thanks. B."), (1, 1, "b", "Yes. Thanks. B."), (1, 1, "c", "Other row. Yes!"),
        (1, 2, "a", "> Yes. Thanks. B.\nfine"), (1, 3, None, ">> yes -- thanks\n> fine\nOn x wrote:\n> b\n\nend"), (1, 4, "a", "On Monday, b wrote:\n>  other ROW\n> > > deep\nlast"),
        (1, 5, "b", "> > nothing said so far\n> last\nok"), (1, 6, "a", ">"), (1, 7, "a", "\t> ok\r\n> ok\n"), (1, 9, "b", None), (1, None, "a", "> Yes. Thanks. A."),
        (None, 0, "a", "alone here"), (None, 1, "b", "> alone here\n> never said"), (2, 0, "a", ""), (2, 1, "b", "ÉTÉ à Paris. Straße 5!"), (2, 2, "b", "> été À paris\n> straße 5\nja"),
        (3, -1, "a", "> later words"), (3, 0, "b", "later words"), (3, 1, "a", "a " * 5000 + "."), (3, 2, "b", "> " + "a " * 5000 + ".\nlong"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = quotes.conversations(quotes.as_mail(frame))
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    names = sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, con.sql(f"SELECT {', '.join(names)} FROM ({quotes.SQL})").fetchall()))


@pytest.mark.parametrize("name", ["op1_quotes", "op4_mixing", "op6_warc", "op8_line_dedup"])
def test_sql(spark, name):
    import duckdb

    from rowproof.llm.queries import QUERIES, SQL

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = QUERIES[name](spark, DATA)
    names = sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, con.sql(f"SELECT {', '.join(names)} FROM ({SQL[name]})").fetchall()))
