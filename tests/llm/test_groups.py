"""Operators on groups of rows: near copies, leaks, neighbours, archive, mixture, conversations, pipeline."""

import base64
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from srclens.llm import ann, chat, decontaminate, mixing, neardup, quality, warc
from srclens.llm.common import connected_components
from srclens.session import new_path
from tests.compare import canonical, difference, duck
from tests.llm.edge import CLASHING, TEXTS, documents

SF = "/root/testdata/sf0.001"


def forest(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_a_long_path_and_a_star(spark):
    rng = random.Random(5)
    path = list(range(200, 260))
    rng.shuffle(path)
    pairs = list(zip(path, path[1:])) + [(7, 1000 + i) for i in range(100)] + [(4, 4), (1, 2), (2, 1)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(pairs, "u long, v long"), "test").collect()}
    want = forest(pairs, {x for p in pairs for x in p})
    assert got == {k: v for k, v in want.items() if k != 4}
    assert connected_components(spark.createDataFrame([], "u long, v long"), "test").count() == 0


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(rows):
    marks = [slow_fingerprint(t) for _, t in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if bin(marks[a] ^ marks[b]).count("1") <= 2]
    root = forest(pairs, range(len(rows)))
    least = defaultdict(list)
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[root[n]].append(i)
    return [(i, f"{marks[n]:016x}", min(least[root[n]], default=None)) for n, (i, _) in enumerate(rows)]


def order(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v if v is not None else 0) for v in r))


@pytest.mark.parametrize("longest", [0, 3, 64])
def test_near_copies_by_brute_force(spark, longest):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(50)]
    base = [rng.choice(words) for _ in range(300)]
    rows = list(TEXTS)
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(300)] = rng.choice(words)
        rows.append((100 + i, " ".join(copy)))
    got = neardup.components(documents(spark, rows), longest=longest)
    got = got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id").collect()
    want = brute_components(rows)
    assert len({c for _, _, c in want}) > 10 and any(c != i for i, _, c in want if i and i >= 100)
    assert order(map(tuple, got)) == order(want)


def test_near_copies_of_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert order(map(tuple, neardup.op5_near_duplicates(spark, SF).collect())) == order(brute_components(rows))


def test_links_by_positional_bytes(spark):
    rng = random.Random(2)
    marks = [rng.getrandbits(64) for _ in range(40)]
    marks += [m ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for m in marks] + [marks[0] ^ 7, marks[1] ^ 1 << 63]
    signed = sorted({m - (1 << 64) if m >> 63 else m for m in marks})
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2}
    frame = spark.createDataFrame([(m,) for m in signed], "fp long")
    assert {tuple(r) for r in neardup.links(frame).collect()} == want
    assert len(neardup.links(frame).collect()) == len(want)


def test_one_of_each_group_stays(spark):
    docs = documents(spark)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({1: 1, 3: 1, 6: 1, 7: 1, 8: 1, 9: 1, None: 2})
    assert neardup.keep_one(docs.limit(0)).count() == 0
    assert neardup.components(docs.limit(0)).count() == 0


def word_shingles(text, words=5):
    found = (text or "").encode("utf-8", "replace").lower().split()
    return {b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def brute_kept(rows):
    """Ids of the rows that stay: the least of each component of texts at a five-word similarity of 0.8 and more."""
    sets = [word_shingles(t) for _, t in rows]
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b) - 1e-9
    root = forest([(a, b) for a in range(len(rows)) for b in range(a) if alike(sets[a], sets[b])], range(len(rows)))
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[root[n]] = min(i, least.get(root[n], i))
    return sorted(least.values())


def edited_copies(seed, copies, length=120, edits=8):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(length)]
    rows = [(1, " ".join(base)), (2, "apart " * 3), (3, ""), (4, None), (5, "one"), (6, "ONE")]
    for i in range(copies):
        copy = list(base)
        for _ in range(rng.randrange(edits)):
            copy[rng.randrange(length)] = rng.choice(words)
        rows.append((10 + i, " ".join(copy[rng.randrange(3) :])))
    return rows


@pytest.mark.parametrize("longest", [1, 5, 64])
def test_stage_finds_edited_copies_by_brute_force(spark, longest):
    rows = edited_copies(11, 150) + [(500 + i, t) for i, t in edited_copies(12, 30, 40, 4)]
    kept = neardup.keep_one(documents(spark, rows), longest=longest)
    want = brute_kept(rows)
    assert sorted(r["doc_id"] for r in kept.collect()) == want
    assert want != sorted({c for _, _, c in brute_components(rows)})


def test_rows_of_one_id_with_different_texts_stay(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, one), (1, two), (1, one), (1, one + " more"), (2, one + " end"), (3, "so " + two), (2, "something else")]
    kept = neardup.keep_one(documents(spark, rows)).select("doc_id", "text").collect()
    assert sorted(map(tuple, kept)) == [(1, one), (1, two), (2, "something else")]


def test_near_copies_stage_on_whole_tables(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        kept = dict(corpus_pipeline.STAGES)["near_copies"](spark, docs, sf)
        # The stage keeps the least id of each component of operator 5 (three words, two bits); ids are unique here.
        want = sorted({c for _, _, c in brute_components([tuple(r) for r in docs.select("doc_id", "text").collect()])})
        assert sorted(r["doc_id"] for r in kept.collect()) == want and kept.columns == docs.columns


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def leak_rows():
    item = ITEM.split()
    return [
        (1, "before it " + ITEM + " after it"),
        (2, "Before. " + ITEM.upper().replace(" ", ", ") + "!"),
        (3, " ".join(item[:10])),
        (4, "so " + " ".join(item[1:]) + " end of it all"),
        (5, " ".join(item[:10] + ["other"] + item[11:])),
        (6, ITEM + " " + ITEM),
        (6, ITEM + " " + ITEM),
        (7, "a short one here"),
        (8, "x short one x"),
        (None, ITEM),
        (9, None),
        (10, ""),
        (11, "word " * 20_000 + ITEM),
        (12, "go go go go go go go go go stop"),
    ]


def items(spark):
    rows = [(1, ITEM), (2, "short one"), (3, ""), (4, None), (5, ITEM), (None, "go go go go go go go go go go")]
    return spark.createDataFrame([(*r, "c") for r in rows], "item_id long, text string, w string")


def brute_leaks(rows, benchmark):
    import regex

    words = lambda t: regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())
    out = set()
    for i, t in rows:
        w = words(t)
        for item, body in benchmark:
            b = words(body)
            if not b or len(w) < len(b):
                continue
            k = min(5, len(b))
            grams = lambda x: Counter(tuple(x[j : j + k]) for j in range(len(x) - k + 1))
            want, best = grams(b), None
            for a in range(len(w) - len(b) + 1):
                shared = sum((grams(w[a : a + len(b)]) & want).values())
                if shared >= 0.8 * (2 * want.total() - shared) - 1e-9 and (best is None or shared > best[0]):
                    best = (shared, a)
            if best:
                out.add((i, item, best[1], len(b), best[0]))
    return out


@pytest.mark.parametrize("shipped", [500_000, 0])
def test_leaks_by_brute_force(spark, monkeypatch, shipped):
    """Also with items too many to ship, when texts are joined to the hits."""
    monkeypatch.setattr(decontaminate, "HINT_ROWS", shipped)
    rows = leak_rows()
    docs = documents(spark, rows)
    bench = items(spark)
    got = decontaminate.leaks(docs, bench).drop("rk").distinct().collect()
    want = brute_leaks([r for r in rows if r[0] != 11], [(r["item_id"], r["text"]) for r in bench.collect()])
    want |= {(11, 1, 20_000, 20, 16), (11, 5, 20_000, 20, 16)}
    assert {tuple(r)[:5] for r in got} == want and len(got) == len(want)
    kept = decontaminate.drop_leaking(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect())) == sorted({r[0] for r in rows} - {w[0] for w in want})
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_neighbours_by_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 16)).astype("float32")
    x[50:90] = x[0]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(5, rows[5][1]), (2000, None), (2050, [0.0] * 16), (2100, [1.0] * 3), (2150, [float("nan")] * 16), (2200, [None] * 16), (None, [1.0] * 16)]
    table = spark.createDataFrame([(*r, "c", "d") for r in rows], "vec_id long, embedding array<float>, key string, vec string")
    got = ann.nearest(table, F.col("vec_id") % 50 == 0, probe=1.0).collect()
    d = x.astype(float)
    n = d / np.linalg.norm(d, axis=1, keepdims=True)
    answers = defaultdict(list)
    for r in got:
        answers[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(answers) == set(range(0, 700, 50))
    hits = 0
    for q in answers:
        score = n @ n[q]
        score[q] = -9
        best = np.lexsort((np.arange(700), -np.round(score, 12)))[:5]
        found = sorted(answers[q])
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        assert all(abs(f[2] - score[f[1]]) < 1e-12 for f in found)
        hits += len({f[1] for f in found} & set(best.tolist()))
    assert hits >= 0.97 * 5 * len(answers)
    assert [v for _, v, _ in sorted(answers[0])] == [50, 51, 52, 53, 54] and [v for _, v, _ in sorted(answers[50])] == [0, 51, 52, 53, 54]
    few = ann.nearest(table.filter("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert {r["vec_id"] for r in few} == {1, 2}
    assert ann.nearest(table.limit(0), F.col("vec_id") == 0).count() == 0


def test_neighbour_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().sort_values("vec_id")
    x = np.array(rows["embedding"].tolist(), dtype=float)
    n, ids = x / np.linalg.norm(x, axis=1, keepdims=True), rows["vec_id"].to_numpy()
    got = ann.op6_nearest(spark, sf).toPandas().groupby("query_id")["vec_id"].apply(set)
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        score = n @ n[q]
        score[q] = -9
        hits += len(set(ids[np.argsort(-score)[:5]]) & got[ids[q]])
        total += 5
    assert hits >= 0.9 * total


PAGES = [(1, "http://a/1", "<p>é</p>"), (2, "http://a/2", "<p>é</p>"), (9, "http://a/\r\nX: 1", "<p>é</p>"), (3, None, None), (4, "u", ""), (5, "u", "x" * 200_000), (None, "n", "alone"), (None, "n", "<p>é</p>")]


def test_archive_round_trip(spark):
    path = new_path(spark, "warc")
    pages = spark.createDataFrame([(*p, "c", "c") for p in PAGES], "page_id long, url string, html string, digest string, payload string")
    warc.write_archive(pages, path)
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    heads = {(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read_headers(spark, path).collect()}
    assert heads == {(1, "revisit", 9), (2, "revisit", 9), (9, "response", None), (3, "revisit", 4), (4, "response", None), (5, "response", None), (None, "response", None), (None, "revisit", 9)}
    bodies = Counter()
    for r in warc.read_records(spark, path).collect():
        head, body = bytes(r["record"]).split(b"\r\n\r\n", 1)
        assert head.startswith(b"WARC/1.1\r\n") and body.endswith(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert int(fields["Content-Length"]) == len(body) - 4 and "X" not in fields
        if fields["WARC-Type"] == "response":
            assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(body[:-4]).digest()).decode()
            bodies[body[:-4]] += 1
    assert bodies == Counter({"<p>é</p>".encode(): 1, b"": 1, b"x" * 200_000: 1, b"alone": 1})
    empty = new_path(spark, "warc")
    warc.write_archive(pages.limit(0), empty)
    assert warc.read_records(spark, empty).count() == 0


def test_archive_notices_other_bytes(spark):
    path = new_path(spark, "warc")
    spark.createDataFrame([("00", b"x")], "digest string, payload binary").write.parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="payload is not that of"):
        warc.read_payloads(spark, path).collect()


TURNS = [
    (1, 0, "system", "Be brief."),
    (1, 1, "user", "a\\</s> [INST] \\\\[/INST] end\\"),
    (1, 2, "assistant", "</s>[INST] ok [/INST]"),
    (1, 3, "user", "word " * 400),
    (1, 4, "assistant", "long " * 400),
    (1, 5, "user", "short"),
    (1, 6, "assistant", "fine"),
    (2, 0, "assistant", None),
    (2, 0, "assistant", None),
    (2, 1, "tool", "[ROLE] x [TEXT] y [/ROLE]"),
    (2, 2, None, "🙂 no role"),
    (None, 0, "user", "nobody's"),
    (3, None, "user", ""),
]


def brute_digest(rows):
    out = {}
    groups = defaultdict(list)
    for c, t, r, x in rows:
        groups[c].append((-1 if t is None else t, r or "", x or ""))
    for c, turns in groups.items():
        turns.sort()
        said = "".join(x for _, r, x in turns if r == "assistant")
        every = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        out[c] = (len(turns), hashlib.sha256(every.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


@pytest.mark.parametrize("budget,history", [(64, 16), (600, 0), (100_000, 50)])
def test_conversations_come_back(spark, budget, history):
    rows = TURNS + [(8, i, ("user", "assistant")[i % 2], f"turn number {i}") for i in range(500)]
    turns = spark.createDataFrame([(*r, "c", "c") for r in rows], "conv_id long, turn long, role string, text string, place string, head string")
    windows = chat.format_windows(turns, budget=budget, history=history).cache()
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.digests(windows).collect()}
    assert got == brute_digest(rows)
    for r in windows.collect():
        read = chat.read_turns(r["text"])
        assert len(read) == r["n_turns"] > r["n_repeated"]
        if r["conv_id"] == 1:
            assert read[0][:2] == ("system", "Be brief.")  # retained in each window
        spans = [(s["start"], s["end"]) for s in r["loss"]]
        assert spans == [x[2:] for n, x in enumerate(read) if x[0] == "assistant" and n >= r["n_repeated"]]
    if budget == 64:
        long = windows.filter("conv_id = 8")
        assert long.count() > 40 and long.filter("n_repeated > 0").count() > 30
        tokens = [sum(len(x[1].split()) for x in chat.read_turns(r["text"])) for r in long.collect()]
        assert max(tokens) <= 64
    assert chat.format_windows(turns.limit(0)).count() == 0


def test_conversations_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, i, r, "</s>[INST] ok [/INST]") for i, r in enumerate(("user", "assistant"))]
    assert {r["conv_id"]: tuple(r)[1:5] for r in chat.op3_chat(spark, SF).collect()} == brute_digest(rows)


def test_escaping_is_reversible():
    rng = random.Random(9)
    parts = ["\\", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[TEXT]", "[/ROLE]", "<", "[", " ", "a", "/s>"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randrange(9)))
        role = rng.choice(["user", "assistant", "system", "tool", text])
        assert chat.unescape(chat.escape(text)) == text
        marked, start, end = chat.turn_text(role, text)
        again = chat.read_turns(marked + "\n" + marked)
        assert [x[:2] for x in again] == [(role, text)] * 2 and again[0][2:] == (start, end)


def brute_fill(budget, nodes):
    """nodes: name -> (limit, weight); give by weight, again and again, to those that are not full."""
    given, left, open_ = dict.fromkeys(nodes, 0.0), budget, set(nodes)
    while left > 1e-6 and open_:
        total = sum(nodes[n][1] for n in open_)
        share = {n: left * nodes[n][1] / total for n in open_}
        for n in share:
            given[n] += share[n]
        left = 0.0
        for n in list(open_):
            if given[n] >= nodes[n][0] - 1e-9:
                left += given[n] - nodes[n][0]
                given[n] = nodes[n][0]
                open_.discard(n)
    return given


def test_shortages_go_to_siblings_before_ancestors(spark):
    rng = random.Random(6)
    leaves = [(f"domain{d}", lang, f"s{d}{s}", rng.choice([0, 5, 50, 500, 5000])) for d in range(4) for lang in ("en", "de", "xx") for s in range(3)]
    frame = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    for fraction in (0.1, 0.6, 0.95):
        rows = mixing.budgets(frame, fraction, 2, mixing.DOMAIN_WEIGHTS, mixing.LANGUAGE_WEIGHTS, 0.05).collect()
        got = {(r["domain"], r["lang"], r["source"]): r["budget"] for r in rows}
        limit = Counter()
        for d, lang, s, t in leaves:
            for key in ((d,), (d, lang), (d, lang, s)):
                limit[key] += 2 * t
        total = int(sum(t for *_, t in leaves) * fraction)
        tops = brute_fill(total, {k: (limit[k], mixing.DOMAIN_WEIGHTS[k[0]]) for k in limit if len(k) == 1})
        for d, b in tops.items():
            mids = brute_fill(b, {k: (limit[k], mixing.LANGUAGE_WEIGHTS.get(k[1], 0.05)) for k in limit if len(k) == 2 and k[:1] == d})
            for m, c in mids.items():
                for leaf, g in brute_fill(c, {k: (limit[k], 1.0) for k in limit if len(k) == 3 and k[:2] == m}).items():
                    assert abs(got[leaf] - g) <= 1 + 1e-3
        assert abs(sum(got.values()) - total) <= len(leaves)


def test_mixture_takes_whole_epochs_and_a_prefix(spark):
    rows = [(i, "w " * (i % 7)) for i in range(300)] + [(None, "x y"), (5, "w " * 5), (301, None)]
    docs = spark.createDataFrame([(*r, ("en", "de")[i % 2], f"src{i % 3}") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    docs = docs.select("*", *[F.lit("c").alias(c) for c in CLASHING])
    got = mixing.mix(docs, fraction=0.9).collect()
    taken, most = Counter(), Counter()
    for r in got:
        taken[(r["domain"], r["lang"], r["source"])] += r["n_tokens"]
    held = Counter()
    for i, (n, t) in enumerate(rows):
        held[(f"domain{i % 3}", ("en", "de")[i % 2], f"src{i % 3}")] += len((t or "").split())
    leaves = spark.createDataFrame([(*k, v) for k, v in held.items()], "domain string, lang string, source string, tokens long")
    for r in mixing.budgets(leaves, 0.9, 3, mixing.DOMAIN_WEIGHTS, mixing.LANGUAGE_WEIGHTS, 0.05).collect():
        most[(r["domain"], r["lang"], r["source"])] = r["budget"]
    assert all(most[k] - 12 <= taken[k] <= most[k] for k in held)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7), fraction=0.9).collect()))
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(documents(spark)).count() > 0


@pytest.mark.parametrize("name", ["op2_decontaminate", "op7_warc", "op8_secrets", "op9_mixing"])
def test_sql_on_larger_tables(spark, name):
    from srclens.llm.registry import ORACLES, QUERIES

    sf = "/root/testdata/sf0.01"
    assert difference(spark, duck(sf), QUERIES[name], ORACLES[name], sf) is None


def duck_on(spark, docs):
    """DuckDB with ``docs`` as its documents and the other tables of the smallest size."""
    path = new_path(spark, "stage-input")
    docs.write.parquet(path)
    con = duck(SF)
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    return con


def test_pipeline_stages_against_plain_readings(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    now = docs.toPandas()
    want = now[model.score(quality.statistics_matrix(now["text"])) >= 0.7]
    stage = dict(corpus_pipeline.STAGES)
    one = stage["quality"](spark, docs, SF).cache()
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(want["doc_id"]) and one.columns == columns
    two = stage["near_copies"](spark, one, SF).cache()
    groups = brute_components([(r["doc_id"], r["text"]) for r in one.collect()])
    assert sorted(r["doc_id"] for r in two.collect()) == sorted({c for _, _, c in groups}) and two.columns == columns
    three = stage["benchmark"](spark, two, SF).cache()
    # The benchmark stage against the SQL of op2 run on the stage's own input, long documents included.
    con = duck_on(spark, two)
    leaked = {r[0] for r in con.execute(f"SELECT DISTINCT doc_id FROM ({decontaminate.OP2_SQL})").fetchall()}
    before = {r["doc_id"] for r in two.collect()}
    left = {r["doc_id"] for r in three.collect()}
    assert leaked and left == before - leaked and three.columns == columns
    four = stage["secrets"](spark, three, SF).cache()
    assert four.columns == columns and {r["doc_id"] for r in four.collect()} == left
    assert four.filter("n_chars <> char_length(text)").count() == 0
    five = stage["mixture"](spark, four, SF).cache()
    # The mixture stage against the SQL of op9 on its own input.
    cur = duck_on(spark, four).execute(mixing.OP9_SQL)
    assert canonical(five.columns, five.collect()) == canonical([d[0] for d in cur.description], cur.fetchall())
    assert five.count() > 0 and {r["doc_id"] for r in five.collect()} <= left
    ran = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, ran.collect())) == sorted(map(str, five.collect()))


def test_stage_keeps_the_least_row_of_each_simhash_group(spark):
    rows = edited_copies(11, 60) + [(500 + i, t) for i, t in edited_copies(12, 20, 40, 4)] + list(TEXTS) + [(1, "another text of one")]
    docs = documents(spark, rows).select("*", F.create_map(F.lit("k"), F.lit("v")).alias("m"), F.lit(1).alias("a.b"))
    kept = neardup.keep_least(docs)
    assert kept.columns == docs.columns
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    marks = [slow_fingerprint(t) for _, t in rows]
    root = forest([(a, b) for a in range(len(rows)) for b in range(a) if bin(marks[a] ^ marks[b]).count("1") <= 2], range(len(rows)))
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[root[n]] = min(i, least.get(root[n], i))
    want = sorted([(False, i) for i in least.values()] + [(True, 0) for i, _ in rows if i is None])
    assert got == want
    assert neardup.keep_least(docs.limit(0)).count() == 0


def test_leaks_of_items_whose_shingles_repeat(spark):
    """Period-two items with the last word changed share 8 of 10 shingles: exactly 0.8, all found."""
    rng = random.Random(9)
    words = [f"x{i}" for i in range(5000)]
    bench, rows = [], []
    for i in range(300):
        a, b, other = rng.sample(words, 3)
        item = [a, b] * 6 + [a]
        bench.append((i, " ".join(item)))
        rows.append((1000 + i, "lead words here " + " ".join(item[:-1] + [other]) + " and the end"))
    rows.append((5000, "nothing of the sort at all in this text"))
    got = decontaminate.leaks(documents(spark, rows), spark.createDataFrame(bench, "item_id long, text string")).drop("rk").distinct().collect()
    want = brute_leaks(rows, bench)
    assert len(want) == 300
    assert {tuple(r)[:5] for r in got} == want
