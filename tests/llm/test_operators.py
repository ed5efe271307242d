import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("fluentlake.llm")

import corpus_pipeline
import duckdb
import public_tokenizers as P
from pyspark.sql import functions as F

from fluentlake.llm import byte_bpe, exact_dedup, jaccard_join, license_scan, lm_scoring, quality_classifier, quality_rules, queries, shared, source_mixing, token_counts, toxicity

DATA = "/root/testdata/sf0.001"
RANKS = P.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, id long, bits string, size long"
LONG = " ".join(f"word{k % 977} of{k}" for k in range(20000)) + "."
TEXTS = [None, "", " \n\t", "A b c\nA b c\n\nA b c", "a B c\na b c\n\na b c", "one", "one", "x  y z \x1c w", "é ü\n\n", "¿qué? 'll 12345 #$%", LONG, LONG + " end", "same text here", "same text here", "same text here"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows, and columns named like the operators' own."""
    rows = [(k, t, "en", f"s{k % 3}", 1, 7, 8, "b", 9) for k, t in enumerate(TEXTS)]
    rows += [rows[3], rows[3], (None, "null id", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def path(docs):
    return docs.withColumn("path", F.concat_ws("/", "source", F.col("doc_id").cast("string")))


LABELS = "doc_id long, toxic int"
OPERATORS = {
    "op1": lambda s, d: quality_rules.repetition_rules(d),
    "op2": lambda s, d: toxicity.toxicity_scores(d, s.createDataFrame([(k, k % 2) for k in range(15)], LABELS)),
    "op3": lambda s, d: lm_scoring.lm_scores(d),
    "op4": lambda s, d: license_scan.scan_licences(path(d)),
    "op5": lambda s, d: token_counts.count_section_tokens(d, RANKS, P.PATTERN),
    "op6": lambda s, d: jaccard_join.near_duplicates(d),
    "op7": lambda s, d: source_mixing.mix_sources(d),
    "op8": lambda s, d: exact_dedup.exact_duplicates(d),
    "op9": lambda s, d: byte_bpe.round_trip_digests(d, RANKS, P.PATTERN),
    "op10": lambda s, d: quality_classifier.quality_scores(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, odd, name):
    found = OPERATORS[name](spark, odd).toPandas()
    assert len(found) >= odd.count() if name == "op5" else len(found) == odd.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, empty, name):
    assert OPERATORS[name](spark, empty).count() == 0


def test_quality_rules_brute_force(spark, odd):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    found = collections.defaultdict(list)
    for r in quality_rules.repetition_rules(odd).collect():
        found[r["doc_id"]].append(r)
    for i, text in docs:
        w = words(text)
        seen, twice = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2)), [False] * len(w)
        for k in range(len(w) - 2):
            if seen[tuple(w[k : k + 3])] > 1:
                twice[k : k + 3] = [True] * 3
        lines, again = set(), 0
        for line in (text or "").split("\n"):
            if words(line):
                again += line in lines
                lines.add(line)
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), again, sum(twice))
        assert any((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want for r in found[i])


def test_repetition_coverage_brute_force(spark):
    rng = np.random.default_rng(3)
    some = lambda n: [f"w{int(v)}" for v in rng.integers(0, 10**6, n)]
    phrase, line = some(7), " ".join(some(9))
    texts = [None, "", " ".join(some(60)), " ".join(some(30) + phrase + some(30) + phrase + some(10)), " ".join((phrase + some(2)) * 9), " ".join(some(40) + 2 * (phrase + phrase[::-1])), "\n".join([" ".join(some(12)), line] * 8), "\n".join([line, " ".join(some(50)), line])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in quality_rules.repetition_rules(docs).collect()}
    for i, text in enumerate(texts):
        w, total = words(text), sum(map(len, words(text)))
        bad = False
        for n, most in quality_rules.MAX_SHARE.items():
            seen, inside = collections.Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)), [False] * len(w)
            for k in range(len(w) - n + 1):
                if seen[tuple(w[k : k + n])] > 1:
                    inside[k : k + n] = [True] * n
            share = sum(len(x) for x, yes in zip(w, inside, strict=True) if yes) / max(total, 1)
            assert abs(found[i][f"share_{n}"] - share) < 1e-12
            bad |= share > most
        lines, again = set(), 0
        for part in (text or "").split("\n"):
            again += sum(map(len, words(part))) if part in lines else 0
            lines.add(part)
        assert abs(found[i]["line_share"] - again / max(total, 1)) < 1e-12
        bad |= again / max(total, 1) > quality_rules.MAX_LINE_SHARE
        failed = len(w) < 50 or 100 * found[i]["n_repeat_words"] > 50 * len(w)
        assert found[i]["base_failed"] == failed and found[i]["kept"] == (not failed and not bad)
    assert any(r["base_failed"] is False and not r["kept"] for r in found.values())


def test_dedup_brute_force(spark, odd):
    groups = collections.defaultdict(list)
    rows = odd.select("doc_id", "text").collect()
    for r in rows:
        groups[hashlib.sha256(lower(r["text"]).encode()).hexdigest()].append(r["doc_id"])
    found = OPERATORS["op8"](spark, odd).collect()
    for r in found:
        ids = groups[r["text_sha256"]]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
    assert sum(r["kept"] for r in found) == len(groups)
    assert exact_dedup.deduplicate(odd).columns == odd.columns and exact_dedup.deduplicate(odd).count() == len(groups)


def test_cuckoo_index():
    rng, index, live = np.random.default_rng(1), exact_dedup.CuckooIndex(2), {}
    for k in range(20000):
        key = hashlib.sha256(str(int(rng.integers(3000))).encode()).digest()
        if key in index:
            assert live[key] == index.get(key)
            assert index.delete(key)
            del live[key]
        else:
            assert key not in live
            index.insert(key, k)
            live[key] = k
    assert dict(index) == live and len(index) == len(live) and index.resizes > 0


@pytest.mark.parametrize("chunk", [1024, 8])
def test_jaccard_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(jaccard_join, "CHUNK", chunk)
    rng = np.random.default_rng(5)
    base = [[f"w{int(x)}" for x in rng.integers(0, 400, 120)] for _ in range(12)]
    docs = []
    for b in base:
        for _ in range(12):
            c = list(b)
            for k in rng.integers(0, 120, int(rng.integers(0, 5))):
                c[k] = f"v{int(rng.integers(1000))}"
            docs.append(" ".join(c[int(rng.integers(0, 4)) :]))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (words(lower(d)) for d in docs)]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    found = jaccard_join.near_duplicates(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {k: find(k) for k in range(len(docs))}


@pytest.mark.parametrize("chunk, shingles", [(1024, 1 << 20), (1024, 3000), (40, 1 << 20)])
def test_jaccard_makes_no_rows_of_pairs(spark, monkeypatch, chunk, shingles):
    """In a large group of near copies of which many do not link, no table of the join has more rows than the posting lists,
    and what is verified last has rows in proportion to the documents."""
    monkeypatch.setattr(jaccard_join, "CHUNK", chunk)
    monkeypatch.setattr(jaccard_join, "SHINGLES", shingles, raising=False)
    rng, made = np.random.default_rng(12), collections.Counter()
    docs = []
    for k in range(400):
        c = [f"w{j}" for j in range(100)]
        for _ in range(1 + k % 3):
            c[int(rng.integers(100))] = f"v{int(rng.integers(10**6))}"
        docs.append(" ".join(c))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(words, docs)]
    component = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if component[a] != component[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((component[a], component[b]))
                component = [x if c == y else c for c in component]
    keep = jaccard_join.stored

    def stored(df, name, *args, **kwargs):
        found = keep(df, name, *args, **kwargs)
        made[name] = found.count()
        return found

    monkeypatch.setattr(jaccard_join, "stored", stored)
    found = jaccard_join.near_duplicates(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == dict(enumerate(component))
    assert 1 < len(set(component)) < len(docs) and max(made.values()) <= made["postings"], made
    assert max(count for name, count in made.items() if name.startswith("rest")) <= 2 * len(docs), made


def test_jaccard_sketch_gets_few_rows_at_once(spark, monkeypatch, tmp_path):
    """Counting shingles reads whole texts, so a worker gets ROWS of them at once, as in the other steps."""
    keep, seen = jaccard_join._sketch, str(tmp_path / "rows")

    def sketch(n):
        inner = keep(n)

        def run(batches):
            def watched():
                for batch in batches:
                    with open(seen, "a") as file:
                        file.write(f"{batch.num_rows}\n")
                    yield batch

            yield from inner(watched())

        return run

    monkeypatch.setattr(jaccard_join, "_sketch", sketch)
    monkeypatch.setattr(jaccard_join, "ROWS", 7)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    texts = spark.createDataFrame([(k, f"a b c {k}".encode()) for k in range(50)], "doc_id long, text binary").coalesce(1)
    level = jaccard_join.commonness(texts, 3)
    with open(seen) as file:
        rows = [int(x) for x in file]
    assert sum(rows) == 50 and max(rows) <= 7
    assert (level > 0).sum() == 51 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_pipeline_encodes_few_rows_at_once(spark, monkeypatch, tmp_path):
    """The last stage of the pipeline gives a worker ROWS whole texts at once, and returns what the operator does."""
    keep, seen = byte_bpe._encoded, str(tmp_path / "rows")

    def encoded(coder, texts):
        with open(seen, "a") as file:
            file.write(f"{len(texts)}\n")
        return keep(coder, texts)

    docs = spark.createDataFrame([(k, f"a word and {k}\nmore") for k in range(50)], "doc_id long, text string").coalesce(1)
    plain = sorted(byte_bpe.round_trip_digests(docs, RANKS, P.PATTERN).collect())
    monkeypatch.setattr(byte_bpe, "_encoded", encoded)
    monkeypatch.setattr(corpus_pipeline, "ROWS", 7, raising=False)
    found = sorted(corpus_pipeline.encode(spark, docs, DATA).collect())
    with open(seen) as file:
        rows = [int(x) for x in file]
    assert found == plain and sum(rows) == 50 and max(rows) <= 7


def test_workers_drop_tables_of_another_operator():
    """The merge tables of op9 stay in a worker while it encodes, and go once it handles another operator's texts."""
    texts = pa.record_batch([pa.array([b"a b c d"])], ["text"])
    for found in byte_bpe._encoded(byte_bpe.replayer(RANKS, P.PATTERN), texts.column(0)):
        list(found)
    coder = byte_bpe.replayer(RANKS, P.PATTERN)
    assert coder.tails and byte_bpe.replayer(RANKS, P.PATTERN) is coder
    assert [len(x) for x in jaccard_join.shingle_sets(*next(shared.text_blocks(texts, "text"))[1:], 3)] == [2]
    assert byte_bpe.replayer.cache_info().currsize == 0


def test_jaccard_join_of_hot_groups_and_repeated_ids(spark):
    """A third of all rows in one group of copies, a rare-looking shingle in many documents, and an id with two texts."""
    rng = np.random.default_rng(9)
    some = lambda n: " ".join(f"x{int(v)}" for v in rng.integers(0, 10**6, n))
    copy, left, right = some(60), some(60), some(60)
    docs = [(k, copy) for k in range(300, 600)] + [(k, "a b c d e " + some(40)) for k in range(600, 900)] + [(7, left), (7, right), (8, left), (5, right), (9, some(50))]
    found = {(r["doc_id"], r["component_id"]) for r in jaccard_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == {(k, 300) for k in range(300, 600)} | {(k, k) for k in range(600, 900)} | {(7, 5), (8, 5), (5, 5), (9, 9)}


def test_small_sources_get_their_target(spark):
    """19 large sources, one of few words at each place, and rows that repeat."""
    for name in ("a", "j", "zz"):
        rows = [(s * 100 + k, " ".join(["w"] * (50 + 7 * k)), f"s{s:02}") for s in range(19) for k in range(40)] + [(5000, "one two three", name)] + [(1, "same row", "s01")] * 3
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
        found = source_mixing.mix_sources(docs, slots=500)
        for r in found.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect():
            assert abs(r["t"] - r["g"]) <= 0.5
        assert found.where("taken > 2 * size").isEmpty() and source_mixing.mixed(docs, slots=500).where("doc_id = 5000").count() in (1, 2)
        assert source_mixing.mixed(docs, slots=500).where("doc_id = 1 and source = 's01'").count() <= 6


def test_shingles_of_many_words():
    data = np.frombuffer(b"a b c d e f g h i j k l", np.uint8)
    assert [len(x) for x in jaccard_join.shingle_sets(data, np.array([0, len(data)]), 10)] == [3]
    assert [len(x) for x in jaccard_join.shingle_sets(data, np.array([0, len(data)]), 20)] == [1]


def test_dedup_of_a_hot_group(spark):
    docs = [(k, "Copy") for k in range(300)] + [(400, "again")] * 200 + [(k, f"text {k}") for k in range(500, 700)] + [(None, "copy")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    found = exact_dedup.exact_duplicates(frame).collect()
    assert sorted(r["doc_id"] for r in found if r["kept"]) == [299, 400, *range(500, 700)]
    assert {(r["keep_id"], r["group_size"]) for r in found if r["doc_id"] in (3, 400, 600)} == {(299, 301), (400, 200), (600, 1)}
    assert sorted(r["doc_id"] for r in exact_dedup.deduplicate(frame).collect()) == [299, 400, *range(500, 700)]


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    want, got = con.execute(queries.oracle_sql()[name]).df(), queries.queries()[name](spark, DATA).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    as_rows = lambda f: sorted(map(str, f[columns].itertuples(index=False, name=None)))
    assert [re.sub(r"\.(\d{6})\d+", r".\1", x) for x in as_rows(got)] == [re.sub(r"\.(\d{6})\d+", r".\1", x) for x in as_rows(want)]


def test_bpe_is_tiktoken(spark, odd):
    import tiktoken

    coder = byte_bpe.MergeReplay(RANKS, P.PATTERN)
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    texts = [r["text"] or "" for r in odd.collect()]
    wanted = collections.Counter(hashlib.sha256(",".join(map(str, theirs.encode_ordinary(t))).encode()).hexdigest() for t in texts)
    found = OPERATORS["op9"](spark, odd).collect()
    assert collections.Counter(r["ids_sha256"] for r in found) == wanted
    assert collections.Counter(r["decoded_sha256"] for r in found) == collections.Counter(hashlib.sha256(t.encode()).hexdigest() for t in texts)
    rng = np.random.default_rng(2)
    pieces = [bytes(rng.choice(list(b"aabbthe ing"), int(rng.integers(1, 30))).tolist()) for _ in range(2000)]
    assert coder.replay(pieces) == [coder.one(p) for p in pieces]


def test_section_tokens_add_up(spark, odd):
    found = OPERATORS["op5"](spark, odd.where("doc_id is not null").dropDuplicates(["doc_id"])).groupBy("doc_id").agg(F.sum("n_tokens").alias("s"), F.max("doc_tokens").alias("d"), F.max("end_char").alias("e"))
    for r in found.collect():
        assert r["s"] == r["d"] and r["e"] == len(TEXTS[r["doc_id"]] or "")
    assert token_counts.allocate(np.array([3, 5]), np.array([2, 4, 5]))[0].tolist() == [1, 1, 0]


def test_lm_base_scores(spark, odd):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    token = lambda t: [*words(lower(t)), None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = collections.Counter(w for i, t in docs if not held(i) for w in token(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((round(float(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in token(t))), 5), len(token(t)), sum(counts[w] > 0 for w in token(t))) for _, t in docs)
    found = OPERATORS["op3"](spark, odd).collect()
    assert sorted((round(r["base_score"], 5), r["n_tokens"], r["n_known"]) for r in found) == want
    assert {r["train_tokens"] for r in found} == {n}


def test_lm_words_are_those_of_bytes():
    """Splitting whole columns gives the same words, tokens and order as lower().split() of each text's bytes."""
    rng = np.random.default_rng(1)
    some = list(bytes(range(256)) + b" \t\n\r\x0b\x0c" * 12 + "É \u00a0\u0085 ẞ".encode() * 4)
    for k in range(300):
        texts = [bytes(rng.choice(some, rng.integers(0, 12)).astype(np.uint8)) for _ in range(k % 5 + 1)]
        for kind in (pa.binary(), pa.large_binary()):
            lengths, tokens, words = lm_scoring._words(pa.array([b"not this", *texts], kind).slice(1))
            words = words.to_pylist()
            wanted = [w for x in texts for w in [*x.lower().split(), b""]]
            assert [words[i] for i in tokens] == wanted and lengths.tolist() == [len(x.split()) + 1 for x in texts]
            assert words == list(dict.fromkeys([b"", *wanted]))


def test_lm_noise_drawn_twice_is_worked_out_once(monkeypatch):
    rng, widths, buffer = np.random.default_rng(2), [], lm_scoring._buffer
    monkeypatch.setattr(lm_scoring, "_buffer", lambda name, rows, columns: widths.append(columns) or buffer(name, rows, columns))
    q, rows = lm_scoring._with_ones(rng.normal(0, 1, (1500, lm_scoring.WIDTH)).astype(np.float32)), rng.normal(0, 1, (9, lm_scoring.WIDTH + 1)).astype(np.float32)
    q[7] *= 1000  # shares beyond the range of floats
    child, noise, log_share = rng.integers(0, 9, 1500), np.repeat([2, 5, 8], [60, 1, 3]), rng.normal(0, 1, 9).astype(np.float32)
    grad, dq = lm_scoring._contrast(q, rows, log_share, child, noise, True)
    odds = rows.astype(np.float64) - np.eye(lm_scoring.WIDTH + 1)[-1] * log_share[:, None]
    share = lambda x: 0.5 + 0.5 * np.tanh(x / 2)
    up, down = 1 - share((q * odds[child]).sum(axis=1)), share(q @ odds[noise].T)
    wanted = np.zeros(rows.shape)
    np.add.at(wanted, child, up[:, None] * q)
    np.add.at(wanted, noise, -(down.T @ q))
    assert np.allclose(grad, wanted, rtol=1e-3, atol=0.02) and np.allclose(dq, up[:, None] * odds[child, :-1] - down @ odds[noise, :-1], rtol=1e-3, atol=0.02)
    assert set(widths) == {3}


def test_lm_is_normalised():
    model = lm_scoring.LogBilinear(np.full(lm_scoring.CLASSES, 1 / lm_scoring.CLASSES))
    seen = np.full((lm_scoring.CLASSES, lm_scoring.CONTEXT), 5)
    assert abs(np.exp(model.log_probabilities(seen, np.arange(lm_scoring.CLASSES))).sum() - 1) < 1e-3


def test_lm_node_is_normalised_and_learns():
    rng = np.random.default_rng(1)
    counts = rng.integers(7, 90, 40).astype(float)
    node, child = lm_scoring.Node(counts), np.repeat(np.arange(40), 50)
    q = rng.normal(0, 1, (40, lm_scoring.WIDTH)).astype(np.float32)[child]  # each word has a context of its own
    assert np.allclose(node.log_probabilities(q[:40], np.arange(40)), np.log((counts + 1e-3) / (counts + 1e-3).sum()), atol=1e-4)
    before = node.log_probabilities(q, child).mean()
    for k in range(30):
        node.train(q, child, 0.1, rng)
    assert node.log_probabilities(q, child).mean() > before + 1
    assert abs(np.exp(node.log_probabilities(np.repeat(q[:1], 40, 0), np.arange(40))).sum() - 1) < 1e-3


def test_lm_node_scores_in_the_pass_that_trains():
    """A node of one part gives the scores of its tokens, held out or not; one of several parts gives its parameters."""
    import pyarrow as pa
    import zstandard

    rng, share = np.random.default_rng(1), np.full(lm_scoring.CLASSES, 1 / lm_scoring.CLASSES)
    params, counts = lm_scoring.LogBilinear(share).flat, [9, 30, 70]
    doc, child, seen = np.array([0, 0, 3, 3, 3], np.int32), np.array([0, 1, 2, 2, 1], np.int32), rng.integers(0, 9, (5, lm_scoring.CONTEXT)).astype("<u2")
    data = zstandard.compress(lm_scoring.planes(np.diff(doc, prepend=np.int32(0))) + lm_scoring.planes(child) + lm_scoring.planes(seen))
    said = {}
    for parts in (1, 2):
        rows = [(7, 0, parts, [0, 1, 2], counts, None, -1, False), (7, 0, None, None, None, data, 5, False), (7, 0, None, None, None, data, 6, True)]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.bool_()]
        batch = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], [str(k) for k in range(8)])
        said[parts] = [r for b in lm_scoring._learn_nodes(share, params, 0.1)(iter([batch])) for r in b.to_pylist()]
    assert [(r["node"], r["n"], r["children"], r["block"]) for r in said[2]] == [(7, 5, 3, None)]
    learnt = lm_scoring.Node(np.ones(3), said[2][0]["params"])
    logs = learnt.log_probabilities(lm_scoring.LogBilinear(share, params).predicted(seen), child) / np.log(10)
    assert [(r["block"], r["node"], list(lm_scoring.unpack(r["pos"]))) for r in said[1]] == [(5, None, [0, 3]), (6, None, [0, 3])]
    for r in said[1]:
        assert np.allclose(np.frombuffer(r["logs"], np.float32), [logs[:2].sum(), logs[2:].sum()], atol=1e-4)


def test_lm_passing_tokens_come_from_blocks():
    """A block's row holds its tokens once; the nodes they pass, their documents, children and contexts come from it."""
    import pyarrow as pa
    import zstandard

    spot = lambda cls, group=-1, slot=0, parts=0: cls + (group + 1 << 8) + (slot << 32) + (parts << 50)
    tokens, lengths = np.array([spot(3), spot(250, 1, 9, 1), spot(0), spot(250, 0, 4, 1), spot(240, 0, 7, 2), spot(0)]), [3, 3]
    data = zstandard.compress(np.array([2], "<i8").tobytes() + np.array(lengths, "<i4").tobytes() + bytes([0, 1]) + lm_scoring.planes(tokens))
    groups = np.ones(lm_scoring.CLASSES, np.int64)
    groups[250] = 2
    batch = pa.RecordBatch.from_arrays([pa.array([5]), pa.array([data], pa.binary())], ["block", "data"])
    rows = [r for b in lm_scoring._passing(groups, np.ones(lm_scoring.CLASSES, np.int64))(iter([batch])) for r in b.to_pylist()]
    found = {(r["node"], r["held_out"]): [x.tolist() for x in lm_scoring.tokens_of(r["data"])] for r in rows}
    none, top = lm_scoring.CLASSES, 250 << 40
    first, second = [[3, none, none]], [[none] * 3]
    assert found == {(top + 2, False): [[0], [9], first], (top, False): [[0], [1], first], (top + 1, True): [[1], [4], second], (top, True): [[1], [0], second], ((240 << 40) + 1, True): [[1], [7], [[250, none, none]]]}
    assert {r["block"] for r in rows} == {5} and {r["part"] for r in rows if r["node"] >> 40 == 250} == {0}


def test_lm_sums_by_context_equal_the_softmax(monkeypatch):
    """Products of factors, tables of sums and scores that are out of range must all give the plain softmax."""
    monkeypatch.setattr(lm_scoring, "OFTEN", 300)
    rng = np.random.default_rng(4)
    model, rows = lm_scoring.LogBilinear(np.full(lm_scoring.CLASSES, 1 / lm_scoring.CLASSES)), rng.normal(0, 1, (90, lm_scoring.WIDTH + 1)).astype(np.float32)
    seen, child = np.minimum(rng.zipf(1.3, (lm_scoring.CONTEXT, 3000)), lm_scoring.CLASSES), rng.integers(0, 90, 3000)
    for scale in (1, 60):
        softmax = lm_scoring.Softmax(model.places(), rows * np.float32(scale))
        scores = (lm_scoring._predicted(model.places(), seen) @ softmax.rows.T).astype(np.float64)
        want = scores[np.arange(3000), child] - scores.max(axis=1) - np.log(np.exp(scores - scores.max(axis=1)[:, None]).sum(axis=1))
        assert np.allclose(softmax(seen, child), want, atol=1e-3)
        assert (softmax.factors is None) == (scale == 60) and (scale == 60 or 0 < softmax.made.sum() < 9)


def test_lm_second_deal_has_nodes_of_several_parts_alone():
    import pyarrow as pa
    import zstandard

    spot = lambda cls, group, slot, parts: cls + (group + 1 << 8) + (slot << 32) + (parts << 50)
    tokens = np.array([spot(250, 1, 9, 1), spot(0, -1, 0, 0), spot(250, 0, 4, 3), spot(240, 0, 7, 1)])
    data = zstandard.compress(np.array([1], "<i8").tobytes() + np.array([4], "<i4").tobytes() + bytes([0]) + lm_scoring.planes(tokens))
    groups, parts = np.ones(lm_scoring.CLASSES, np.int64), np.ones(lm_scoring.CLASSES, np.int64)
    groups[250], parts[250] = 70_000, 2  # more nodes than numbers of 16 bits
    batch = pa.RecordBatch.from_arrays([pa.array([5]), pa.array([data], pa.binary())], ["block", "data"])
    nodes = [[r["node"] for b in lm_scoring._passing(groups, parts, split)(iter([batch])) for r in b.to_pylist()] for split in (False, True)]
    top = 250 << 40
    assert sorted(nodes[0]) == [(240 << 40) + 1, top, top + 1, top + 2] and sorted(nodes[1]) == [top, top + 1]


def test_lm_tree_brute_force(spark, monkeypatch):
    """Without training, nodes of several groups and parts must give each word its share of its class's counts."""
    monkeypatch.setattr(lm_scoring, "GROUP", 24)
    monkeypatch.setattr(lm_scoring, "PART_TOKENS", 1500)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").repartition(3)
    found = {r["doc_id"]: r["score"] for r in lm_scoring.lm_scores(docs, rates=(), node_rate=0.0).collect()}
    texts = {r["doc_id"]: [*(w.encode() for w in words(lower(r["text"]))), b""] for r in docs.collect()}
    counts = collections.Counter(w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    common = {w: k + 1 for k, (w, _) in enumerate(sorted(((w, c) for w, c in counts.items() if w), key=lambda x: (-x[1], x[0]))[: lm_scoring.COMMON])} | {b"": 0}

    def cls(w):
        size = min(max(int(np.log2(counts[w] + 1)), 1), lm_scoring.BY_COUNT) - 1
        return common.get(w, 1 + lm_scoring.COMMON + size * lm_scoring.BY_END + zlib.crc32(w[-2:]) % lm_scoring.BY_END)

    own, mass, seen = collections.Counter(), collections.Counter(), np.full(lm_scoring.CLASSES, 0.5)
    for w, c in counts.items():
        mass[cls(w)] += c + 1
        own[cls(w)] += c
        seen[cls(w)] += c
    for k in range(lm_scoring.BY_END):
        mass[1 + lm_scoring.COMMON + k] += 1
    model = lm_scoring.LogBilinear(seen / seen.sum())
    vectors = lambda w: w not in common and counts[w] >= 7
    assert sum(map(vectors, counts)) > 100 and found.keys() == texts.keys()
    for i, t in texts.items():
        at, targets, _ = lm_scoring.contexts([bytes(map(cls, t))])
        want = model.log_probabilities(at, targets).sum() / np.log(10)
        want += sum(np.log10(counts[w] / own[cls(w)] if vectors(w) else (counts[w] + 1) / mass[cls(w)]) for w in t)
        assert abs(found[i] - want) < 1e-3 * len(t)


def test_lm_beats_counts_on_held_out_text(spark):
    found = lm_scoring.lm_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert found[0] > found[1]


def test_lm_gain_over_counts_at_full_width(spark):
    found = lm_scoring.lm_scores(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert found[0] > 0.96 * found[1]


def test_toxicity_on_held_out_text_and_with_gaps(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    texts, y = toxicity.training_sample(docs, labels, "doc_id", "text", 3, 1, 300)
    model = toxicity.train(texts, y)
    scores = model.scores([b"You idiot and moron.", b"you i d i o t and m.o.r.o.n", b"the quick brown fox.", b""])
    assert scores[0] > 0.7 and scores[1] > 0.7 and scores[2] < 0.3 and 0 <= scores[3] < 0.7
    held = labels.where("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1").join(docs, "doc_id").select("text", "toxic").toPandas()
    said = model.scores([t.encode() for t in held.text]) >= 0.7
    assert said[held.toxic == 1].mean() > 0.8 and said[held.toxic == 0].mean() < 0.03


def test_held_out_quality(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = quality_classifier.quality_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("k"))
    kept = {r["quality"]: r["k"] for r in found.collect()}
    assert kept[1] > 0.97 and kept[0] < 0.1


def test_licences_are_inherited(spark):
    files = [("a/LICENSE", "Released under the MIT License."), ("a/b/c.py", "code"), ("a/b/d.py", "x = 1\nLicensed under the Apache License, Version 2.0."), ("z/e.py", "code"), ("a/b/LICENSE", "nothing"), (None, None)]
    found = {r["path"]: (r["licence"], r["licence_dir"]) for r in license_scan.scan_licences(spark.createDataFrame(files, "path string, text string")).collect()}
    assert found == {"a/LICENSE": ("MIT", None), "a/b/c.py": ("MIT", "a"), "a/b/d.py": ("Apache-2.0", None), "z/e.py": (None, None), "a/b/LICENSE": ("MIT", "a"), "": (None, None)}


def test_whole_licences_and_headers(spark):
    text = lambda name: open(f"/usr/share/common-licenses/{name}").read()
    mit = 'The MIT License\n\nCopyright (c) 2020 A. Body\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n'
    gnu = "# Copyright (C) 2020 A. Body\n#\n# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n#\n# This program is distributed in the hope that it will be useful,\n# but WITHOUT ANY WARRANTY; without even the implied warranty of\n# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\n# GNU General Public License for more details.\n#\n# You should have received a copy of the GNU General Public License\n# along with this program.  If not, see <https://www.gnu.org/licenses/>.\nimport sys\nprint(sys.argv)\n"
    files = [("a/LICENSE", mit), ("b/COPYING", text("GPL-3")), ("b/x.py", "code"), ("c/LICENSE", text("Apache-2.0")), ("d/LICENSE", text("BSD")), ("e/COPYING", text("GPL-2")), ("f/legal.txt", text("MPL-2.0")), ("f/y.py", "code"),
             ("g/z.py", gnu), ("h/a.c", "// SPDX-License-Identifier: MIT\nint x;"), ("i/LICENSE", "MIT License"), ("j/b.py", "x = 1  # no license word that names one\n")]
    found = {r["path"]: r["licence"] for r in license_scan.scan_licences(spark.createDataFrame(files, "path string, text string")).collect()}
    assert found == {"a/LICENSE": "MIT", "b/COPYING": "GPL-3.0", "b/x.py": "GPL-3.0", "c/LICENSE": "Apache-2.0", "d/LICENSE": "BSD-3-Clause", "e/COPYING": "GPL-2.0", "f/legal.txt": "MPL-2.0", "f/y.py": "MPL-2.0",
                     "g/z.py": "GPL-3.0", "h/a.c": "MIT", "i/LICENSE": "MIT", "j/b.py": None}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        assert 0 < out.count()
        out.write.parquet(to := corpus_pipeline.scratch(spark, "test"))
        docs = spark.read.parquet(to)


def test_pipeline_stages_brute_force(spark, tmp_path):
    stages = [stage for _, stage in corpus_pipeline.STAGES]
    rows = lambda d: sorted(map(str, d.collect()))

    def after(k, docs):
        stages[k](spark, docs, DATA).write.parquet(to := str(tmp_path / f"stage-{k}"))
        return spark.read.parquet(to)

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    good = after(0, docs)
    kept = {r["doc_id"] for r in quality_classifier.quality_scores(docs).where("kept").collect()}
    assert rows(good) == sorted(str(r) for r in docs.collect() if r["doc_id"] in kept)

    last = {}
    for r in sorted(good.collect(), key=lambda r: r["doc_id"]):
        last[lower(r["text"])] = r
    single = after(1, good)
    assert rows(single) == sorted(map(str, last.values()))

    found = sorted(single.collect(), key=lambda r: r["doc_id"])
    split = [words(lower(r["text"])) for r in found]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in split]
    group = list(range(len(found)))
    for a in range(len(found)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((group[a], group[b]))
                group = [x if g == y else g for g in group]
    apart = after(2, single)
    assert rows(apart) == sorted(str(r) for k, r in enumerate(found) if group[k] == k)

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/stage-2/*.parquet'")
    times = {i: 1 if size == 0 else (2 * taken + size) // (2 * size) for i, size, taken in con.execute(f"select doc_id, size, taken from ({source_mixing.ORACLE_SQL})").fetchall()}
    mixed = after(3, apart)
    assert rows(mixed) == sorted(str(r) for r in apart.collect() for _ in range(times[r["doc_id"]]))
    assert rows(after(4, mixed)) == rows(corpus_pipeline.run(spark, DATA))


def test_bpe_of_other_patterns(spark):
    """A pattern whose matches take line breaks along: words must not be cut there."""
    import tiktoken

    pattern = r" ?[^\s\w]+[\r\n]*|\w+|\s+"
    coder = byte_bpe.MergeReplay(RANKS, pattern)
    theirs = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=coder.ranks, special_tokens={})
    texts = ["one two.\n\nthree!\nfour", "a b\nc d", "x ;\n y"]
    found = byte_bpe.encode_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), RANKS, pattern)
    assert {r["doc_id"]: r["ids"] for r in found.collect()} == {k: theirs.encode_ordinary(t) for k, t in enumerate(texts)}


def test_section_tokens_brute_force(spark):
    """Token by token and byte by byte: most bytes win, the earlier section on a tie."""
    import tiktoken

    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.MergeReplay(RANKS, P.PATTERN).ranks, special_tokens={})
    texts = ["one two\nthree\n\n\nfour  \n  five", "\n\n\n", "é\n ü\n", "a", "x \n\ty\n\n\n z", "end\n"]
    found = token_counts.count_section_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), RANKS, P.PATTERN).collect()
    for i, text in enumerate(texts):
        data, section, sections = text.encode(), 0, []
        for k, b in enumerate(data):
            sections.append(section)
            section += b == 10 and k < len(data) - 1
        counts, crossing, at = collections.Counter(), collections.Counter(), 0
        for token in theirs.encode_ordinary(text):
            size = len(theirs.decode_single_token_bytes(token))
            inside = collections.Counter(sections[at : at + size])
            best = min(inside, key=lambda s: (-inside[s], s))
            counts[best] += 1
            crossing[best] += len(inside) > 1
            at += size
        got = {r["section"]: (r["n_tokens"], r["n_crossing"], r["doc_tokens"]) for r in found if r["doc_id"] == i}
        assert got == {s: (counts[s], crossing[s], sum(counts.values())) for s in range(section + 1)}
        parts = text.split("\n")
        ends = np.cumsum([len(p) + 1 for p in parts])[: section + 1].tolist()
        assert [r["end_char"] for r in sorted((r for r in found if r["doc_id"] == i), key=lambda r: r["section"])] == [min(e, len(text)) for e in ends]


def test_inheritance_brute_force(spark):
    """Random trees: a file without a licence has that of the nearest directory above it with one."""
    rng = np.random.default_rng(4)
    says = {"MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", None: "x = 1"}
    files = {}
    for _ in range(120):
        parts = [str(int(v)) for v in rng.integers(0, 3, int(rng.integers(0, 5)))]
        files["/".join([*parts, "LICENSE" if rng.random() < 0.2 else f"f{int(rng.integers(100))}.py"])] = [*says][int(rng.integers(0, 3))]
    found = license_scan.scan_licences(spark.createDataFrame([(p, says[x]) for p, x in files.items()], "path string, text string")).collect()
    gives = {p.rpartition("/")[0]: x for p, x in sorted(files.items()) if x and p.endswith("LICENSE")}
    gives |= {p.rpartition("/")[0]: x for p, x in sorted(files.items(), reverse=True) if x and not p.endswith("LICENSE") and p.rpartition("/")[0] not in gives}
    for r in found:
        folder, want = r["path"].rpartition("/")[0], files[r["path"]]
        while want is None:
            if folder in gives:
                want = gives[folder]
                break
            if not folder:
                break
            folder = folder.rpartition("/")[0]
        assert (r["licence"] is None) == (want is None)
        if files[r["path"]]:
            assert r["licence"] == files[r["path"]]


def test_subsequence_kernel_brute_force():
    """All common subsequences of four characters, each by the spans that it takes."""
    import itertools

    def plain(a, b):
        total = 0.0
        spots = collections.defaultdict(float)
        for at in itertools.combinations(range(len(b)), toxicity.ORDER):
            spots["".join(b[k] for k in at)] += toxicity.DECAY ** (at[-1] - at[0] + 1)
        for at in itertools.combinations(range(len(a)), toxicity.ORDER):
            total += spots["".join(a[k] for k in at)] * toxicity.DECAY ** (at[-1] - at[0] + 1)
        return total

    words, marks = ["^idiot$", "^i.d.iot$", "^abcabc$", "^xy$"], ["^idio", "abca", "diot$"]
    found = toxicity.subsequence_kernel(words, marks)
    for i, w in enumerate(words):
        for k, m in enumerate(marks):
            assert abs(found[i, k] - plain(w, m)) < 1e-4 * max(1, plain(w, m))


def test_subsequence_kernel_is_frugal(monkeypatch):
    """Short words and marks, characters of no mark; few words at once, and a word is brought to its plain form once."""
    import itertools
    import tracemalloc

    words, marks = ["", "^a$", "^ab$", "^abc$", "^☃ab$", "^xabyczd$"], ["^ab", "^abc", "abczd$"]
    found = toxicity.subsequence_kernel(words, marks)
    assert (found[:3] == 0).all() and (found[:, 0] == 0).all() and found[4, 2] == 0
    assert found[3, 1:].tolist() == pytest.approx([toxicity.DECAY**8, toxicity.DECAY**10])
    at, of = {"a": 2, "b": 3, "c": 5, "z": 6, "d": 7, "$": 8}, "abczd$"
    want = sum(toxicity.DECAY ** (at[c[3]] - at[c[0]] + 1 + of.index(c[3]) - of.index(c[0]) + 1) for c in itertools.combinations(of, 4))
    assert found[5, 2] == pytest.approx(want, rel=1e-4)
    tracemalloc.start()
    toxicity.subsequence_kernel([f"^{k:06d}$" for k in range(4096)], [f"^{k:06d}" for k in range(32)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 << 20

    calls, plain = collections.Counter(), toxicity.plain
    monkeypatch.setattr(toxicity, "plain", lambda w: calls.update([w]) or plain(w))
    model = toxicity.ToxicityModel(["^idiot$"], np.ones(1, np.float32), np.ones(1), 0.0, np.zeros(5))
    model.scores([b"You idiot. You Idiot!", b"you, idiot."])
    assert set(calls.values()) == {1} and len(model.known) == 4
