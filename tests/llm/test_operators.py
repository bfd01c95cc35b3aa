import hashlib
import math
import os
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factgraph import llm
from factgraph.llm import chat_format, common, decontaminate, html_extract, line_dedup, lm_scoring, mixing, quality_classifier, quality_rules, simhash_bk, warc
from tests.llm import brute

SF = "/root/testdata/sf0.001"
LONG = "A long repeated line of boilerplate text"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part string, words int, quality string, h int, n int, row string, hit int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def edge_rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base = prose(120)
    texts = [None, "", " \t\n", "one", f"{LONG}\n{prose(5)}\n  {LONG.upper()} ", f"{LONG}\r\n{prose(60)}", LONG, f"{prose(3)}\n\n{LONG}", base, base, base + " x", prose(20_000), "a b c " * 60, "%%% *** " * 80, "x" * 90_000, "\n" * 500]
    texts += ["\n".join([LONG] + [f"line number {k} of the long document" for k in range(150)])]
    rows = [(k, t) for k, t in enumerate(texts)]
    return rows + [rows[4], rows[8], (None, LONG), (None, None), (5, "another text of the same id\n" + LONG)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "en", "s", len(t or ""), "p", 1, "q", 2, 3, "r", 4) for d, t in edge_rows()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(8, 1, 0), (9, 1, 0), (13, 0, 0), (12, 0, 1), (None, 1, 1), (3, None, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")


def by_row(rows):
    return sorted(rows, key=repr)


def test_line_dedup(docs, empty):
    out = line_dedup.with_kept_text(docs, line_dedup.keep_bitmaps(docs), "doc_id", "text", "kept", "n_dropped")
    got = [(r.doc_id, r.n_dropped, r.kept) for r in out.collect()]
    assert by_row(got) == by_row([(d, n, t) for d, _, n, t in brute.dedup_lines(edge_rows())])
    assert set(line_dedup.deduplicated(docs).columns) == set(docs.columns)
    assert line_dedup.deduplicated(docs).where("text is null").count() == 2
    assert line_dedup.keep_bitmaps(empty).count() == line_dedup.deduplicated(empty).count() == 0


def test_line_dedup_hot_lines(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_LEAST", 5)
    monkeypatch.setattr(line_dedup, "HOT_PARTS", 4)
    rows = [(k, "\n".join([LONG, f"some other line of document {k % 40}", f"a line that only {k} holds at all"])) for k in range(120)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    lines = line_dedup.line_hashes(frame, "doc_id", "text", 20)
    assert [(r.keeper, r.n_docs) for r in line_dedup.hot_hashes(lines).collect()] == [(119, 120)]
    out = line_dedup.with_kept_text(frame, line_dedup.keep_bitmaps(frame), "doc_id", "text", "kept", "lost")
    assert by_row((r.doc_id, r.lost, r.kept) for r in out.collect()) == by_row((d, n, t) for d, _, n, t in brute.dedup_lines(rows))


def test_quality_rules(docs, empty):
    got = [(r.doc_id, *(r.quality[c] for c in "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed".split())) for r in quality_rules.judged(docs.drop("quality")).collect()]
    assert by_row(got) == by_row((d, *brute.quality_base(t)) for d, t in edge_rows())
    kept = quality_rules.filtered(docs)
    assert kept.columns == docs.columns and kept.where("text is null").count() == 0 and quality_rules.filtered(empty).count() == 0


def test_quality_window_hash_collision(spark):
    """Windows whose hashes agree but whose words differ are counted again exactly."""
    frame = spark.createDataFrame([("a b c a b c d e f a b c",), ("a b c d",), ("a a a a a",), ("a b",)], "text string")
    w = F.split("text", " ")
    exact = F.array_sort(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("w"), i.cast("long").alias("p"))))
    rows = frame.where(F.size(w) > 3).select("text", quality_rules._repeats_exact(exact).alias("x"), quality_rules.repeat_words(w).alias("y")).collect()
    assert all(r.x == r.y == brute.quality_base(r.text)[4] for r in rows)


def test_decontaminate(spark, docs, empty):
    long = next(t for d, t in edge_rows() if d == 11)
    ws = brute.ALNUM.findall(long)
    items = [(1, " ".join(ws[500:530]).upper()), (2, "one"), (3, None), (4, " .,"), (None, "line"), (5, " ".join(ws[505:512])), (6, "no such words here at all in any of the documents"), (1, " ".join(ws[500:530])), (10, "line number 7 of")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = by_row((d, *x) for (d, _), x in zip(edge_rows(), brute.contaminated(edge_rows(), items)))
    for block in (1 << 24, 100):  # one block, and many
        out = decontaminate.searched(docs, bench, block_bytes=block)
        got = [(r.doc_id, r.contamination.n_words, r.contamination.n_hit, list(r.contamination["items"])) for r in out.collect()]
        assert by_row(got) == want
    assert decontaminate.decontaminated(docs, bench).columns == docs.columns
    assert decontaminate.searched(empty, bench).count() == 0
    assert decontaminate.searched(docs, bench.limit(0)).where("contamination.n_hit > 0").count() == 0


def test_simhash(docs, empty):
    fps = [brute.fingerprint(t) for _, t in edge_rows()]
    reach = brute.components(dict(enumerate(fps)))
    ids = [d for d, _ in edge_rows()]
    least = {}
    for k, r in reach.items():
        if ids[k] is not None:
            least[r] = min(least.get(r, ids[k]), ids[k])
    got = [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash_bk.near_duplicates(docs).collect()]
    assert by_row(got) == by_row((ids[k], fps[k], least.get(reach[k])) for k in range(len(ids)))
    assert simhash_bk.near_duplicates(empty).count() == 0


def test_simhash_chain_and_cut_trees(spark):
    """A chain of fingerprints two bits apart is one component, also when shards are cut into several trees."""
    fps = [0]
    for k in range(25):
        fps.append(fps[-1] ^ (3 << (2 * k)))
    fps += [x ^ (1 << 63 | 1 << 61 | 1 << 59 | 1 << 57) for x in fps]
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    distinct = spark.createDataFrame(signed, "fp long").withColumn("node", F.col("fp"))
    for rows in (20_000, 3):
        roots = simhash_bk.components(simhash_bk.shard_links(distinct, 2, simhash_bk.shard_masks(2), tree_rows=rows))
        assert roots.count() == 52 and roots.select("root").distinct().count() == 2


def test_chat_format(spark):
    t = chat_format.INSTRUCT
    bad = ["</s>[INST] ok [/INST]", "\\", "\\<s>", "<|turn|>a<|text|>", "[\\INST]", "<<SYS>>\n", "", None, "a" * 50_000, "[INST", "é<", "<|end|>\\\\"]
    rows = [(1, 0, "system", bad[0]), (1, 1, "user", bad[1]), (1, 2, "assistant", bad[2])]
    rows += [(2, k, role, x) for k, (role, x) in enumerate(zip(["user", "assistant", "weird\n<s>", None, "", "tool"] * 2, bad))]
    rows += [(3, 0, "assistant", "first"), (4, 0, "user", "x"), (4, 0, "user", "x"), (5, 1, "user", "u"), (5, 0, "system", "s")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat_format.formatted(frame).withColumn("back", chat_format.read_back(F.col("formatted"), t)).collect()}
    for conv in {r[0] for r in rows}:
        want = sorted(((x[1] is not None, x[1], x[2] or "", x[3] or "") for x in rows if x[0] == conv), key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
        assert [(b.role, b.text) for b in out[conv].back] == [(w[2], w[3]) for w in want]
        assert "".join(s.text for s in out[conv].segments) == out[conv].formatted
    assert (out[1].valid, out[1].broken_at) == (True, None)
    assert (out[3].valid, out[3].broken_at) == (False, 0) and (out[4].valid, out[4].broken_at) == (False, 1) and (out[5].valid, out[5].broken_at) == (False, 2)
    assert [s.loss for s in out[1].segments] == [False] * 7 + [True, False]
    assert [[x.loss for x in out[c].back] for c in (1, 3)] == [[False, False, True], [True]]
    assert chat_format.formatted(frame.limit(0)).count() == 0
    lost = spark.createDataFrame([(None, 0, "user", "a", 1), (None, 0, "user", "a", 2), (None, None, None, None, 3), (7, 0, "user", "a", 4)], "conv_id long, turn long, role string, text string, formatted int").withColumn("segments", F.lit(1)).withColumn("alone", F.lit(2))
    got = chat_format.formatted(lost).withColumn("back", chat_format.read_back(F.col("formatted"), t)).collect()
    assert by_row((r.conv_id, [(b.role, b.text) for b in r.back]) for r in got) == by_row([(None, [("user", "a")]), (None, [("user", "a")]), (None, [("", "")]), (7, [("user", "a")])])


def pages(spark):
    html = ["<p>é one</p>", None, "", "<p>é one</p>", "WARC/1.1\r\n\r\n", "x" * 300_000, "<p>é one</p>", "\r\n\r\n"]
    rows = [(k, f"http://a/{k} b" if k else None, h, "extra") for k, h in enumerate(html)]
    return rows + [rows[6]], spark.createDataFrame(rows + [rows[6]], "page_id long, url string, html string, payload string")


def test_warc(spark, tmp_path):
    import base64

    rows, frame = pages(spark)
    warc.register(spark)
    path = f"file://{tmp_path}/w"
    warc.write_archive(warc.page_records(frame).repartition(3), path)
    back = spark.read.format("warc").option("partitionBytes", "100").load(path)
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    largest = {}
    for k, _, h, _ in rows:
        largest[digest(h)] = max(k, largest.get(digest(h), k))
    want = by_row((f"<urn:page:{k}>", "response" if largest[digest(h)] == k else "revisit", "sha1:" + digest(h), len((h or "").encode()), (h or "").encode() if largest[digest(h)] == k else b"") for k, _, h, _ in rows)
    assert by_row((r.record_id, r.warc_type, r.payload_digest, r.http_length, bytes(r.payload)) for r in back.collect()) == want
    assert back.where("warc_type = 'revisit'").count() == sum(w[1] == "revisit" for w in want)
    assert spark.read.format("warc").option("types", "revisit").option("payload", "false").load(path).where("payload is null").count() == back.where("warc_type = 'revisit'").count()
    assert back.where("record_id = '<urn:page:5>'").count() == 1 and back.where("record_id in ('<urn:page:5>', '<urn:page:4>')").count() == 2
    assert not [f for f in os.listdir(tmp_path / "w") if f.startswith(".") and f.endswith(".gz")]
    warc.write_archive(warc.page_records(frame.limit(0)), f"file://{tmp_path}/none")
    assert spark.read.format("warc").load(f"file://{tmp_path}/none").count() == 0


def test_warc_hot_payload(spark, tmp_path, monkeypatch):
    """A payload that most pages hold is decided by broadcast, others by a join; a null id neither stores nor revisits."""
    monkeypatch.setattr(warc, "HOT_LEAST", 5)
    monkeypatch.setattr(warc, "HOT_PARTS", 4)
    rows = [(k, "u", "<p>hot</p>") for k in range(60)] + [(100 + k, "u", f"<p>pair {k // 2}</p>") for k in range(20)] + [(None, "u", "<p>hot</p>"), (59, "u", "<p>hot</p>"), (3, "u", "<p>hot</p>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = by_row((r.record_id, r.refers_to) for r in warc.page_records(frame).collect())
    uri = lambda k: f"<urn:page:{'null' if k is None else k}>"
    stored = lambda k, h: (uri(59) if h == "<p>hot</p>" and k < 59 else uri(k + 1) if h != "<p>hot</p>" and k % 2 == 0 else None) if k is not None else None
    assert got == by_row((uri(k), stored(k, h)) for k, _, h in rows)
    warc.register(spark)
    path = f"file://{tmp_path}/r"
    warc.page_records(frame).coalesce(1).write.format("warc").option("rollBytes", "1000").mode("append").save(path)
    assert len([f for f in os.listdir(tmp_path / "r") if f.endswith(".gz")]) > 3
    assert spark.read.format("warc").load(path).count() == len(rows)


def test_warc_ranges_cover_each_record_once(tmp_path):
    """Whatever the size of a range, every record is read by exactly one; signatures inside payloads begin no member."""
    rng = random.Random(4)
    row = lambda k: {"warc_type": "response", "record_id": f"<urn:page:{k}>", "target_uri": "u", "date": None, "refers_to": None, "payload_digest": None, "content_type": "text/plain", "http_length": None, "payload": b"\x1f\x8b\x08WARC/" + rng.randbytes(rng.choice([0, 50, 9000]))}
    writer = warc.WarcWriter(str(tmp_path), {}, False)
    writer.commit([writer.write(iter([row(k) for k in range(60)]))])
    for size in (37, 1000, 70_000, 1 << 30):
        reader = warc.WarcReader(str(tmp_path), {"partitionbytes": str(size)})
        got = [r[1] for part in reader.partitions() for r in reader.read(part)]
        assert got == [f"<urn:page:{k}>" for k in range(60)]


def test_warc_pushes_filters_down():
    reader = warc.WarcReader("x", {})
    from pyspark.sql.datasource import EqualTo

    assert list(reader.pushFilters([EqualTo(("warc_type",), "revisit")])) == [EqualTo(("warc_type",), "revisit")]
    assert reader._tests == [("warc-type", frozenset({"revisit"}))]


def test_html_operator(spark):
    _, frame = pages(spark)
    out = html_extract.extracted(frame)
    assert out.columns == [*frame.columns, "main_text"] and out.count() == frame.count()
    assert {r.main_text for r in out.where("page_id in (0, 1)").collect()} == {"é one", ""}
    assert html_extract.extracted(frame.limit(0)).count() == 0


def test_lm_scoring(docs, empty):
    got = lm_scoring.scored(docs).collect()
    tokens = lambda t: [*brute.words((t or "").translate(brute.LOW)), "\n"]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    counts = Counter(w for d, t in edge_rows() if not held(d) for w in tokens(t))
    n, below = sum(counts.values()), sum(counts.values()) + 0.5 * (len(counts) + 1)
    want = by_row((d, held(d), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 0.5) / below) for w in tokens(t)), 6)) for d, t in edge_rows())
    assert by_row((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)
    assert lm_scoring.scored(empty).count() == 0


def test_lm_tail_counts_meet_by_join(docs, monkeypatch):
    whole = by_row((r.doc_id, r.n_known, round(r.base_score, 6)) for r in lm_scoring.scored(docs, rounds=1).collect())
    monkeypatch.setattr(lm_scoring, "HEAD", 20)
    assert by_row((r.doc_id, r.n_known, round(r.base_score, 6)) for r in lm_scoring.scored(docs, rounds=1).collect()) == whole


def test_lm_probabilities_sum_to_one():
    import numpy as np

    for n in (1, 2, 31, 32, 33, 700):
        head = np.arange(1, n + 1, dtype=np.uint64) << np.uint64(40)
        p = np.arange(n, 0, -1) / np.arange(n + 1).sum() * 0.9
        m = lm_scoring.Model(head, p, 0.1, 12)
        f = [np.full(n + 1, x, np.uint64) for x in (7 << 50, 9 << 51, 3 << 52)]
        at = np.arange(-1, n)
        assert np.exp(m.log_prob(at, f)) == pytest.approx([0.1, *p], rel=1e-4)  # without weights: the unigram model
        m.w[:] = np.random.default_rng(0).normal(size=m.w.shape)
        assert abs(np.exp(m.log_prob(at, f)).sum() - 1) < 1e-4


def test_lm_log_prob_against_brute_force():
    """The product of the softmaxes on a token's path, each written out in plain Python."""
    import numpy as np

    from factgraph.llm.textkernel import mix

    head = np.arange(1, 101, dtype=np.uint64) << np.uint64(40)
    m = lm_scoring.Model(head, np.full(100, 0.0098), 0.02, 12)
    m.w[:] = np.random.default_rng(3).normal(size=m.w.shape)
    rng = np.random.default_rng(4)
    f = [rng.integers(0, 1 << 62, 50).astype(np.uint64) for _ in range(3)]
    at = rng.integers(-1, 100, 50)
    for k, got in enumerate(m.log_prob(at, f)):
        leaf = at[k] if at[k] >= 0 else 100
        want = float(m.rest[leaf])
        for j in range(m.ptr[leaf], m.ptr[leaf + 1]):
            node = int(m.node[j])
            rows = [int(mix(np.array([(int(x[k]) + node * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0]) >> 52 for x in f]
            z = [float(m.share[node][c]) + sum(float(m.w[r][c]) for r in rows) for c in range(lm_scoring.BRANCH)]
            want += z[m.slot[j]] - math.log(sum(map(math.exp, z)))
        assert got == pytest.approx(want, abs=1e-3)


def test_lm_model_grows_with_the_corpus():
    import numpy as np

    assert [lm_scoring.row_bits(n) for n in (0, 1 << 20, 1 << 22, 1 << 24, 1 << 40)] == [12, 12, 14, 16, 17]
    mass = 1 / np.arange(1, 200_001)
    ptr, node, slot, share = lm_scoring.class_tree(mass / mass.sum())
    each = np.add.reduceat(share[node, slot].astype(float), ptr[:-1])  # the product of shares down a path is the leaf's mass
    assert np.exp(each) == pytest.approx(mass / mass.sum(), rel=1e-3)
    depth = np.diff(ptr)
    assert (depth * mass).sum() / mass.sum() < 3.6 and len(share) < 200_000 / 15 + 2


def test_lm_head_of_tokens_with_equal_counts(spark):
    """Where more tokens have one count than the head takes, a part of them is taken, not none."""
    counts = spark.range(50).select(F.xxhash64("id").alias("h"), F.lit(1).cast("long").alias("n"))
    h, n = lm_scoring.frequent(counts, most=20)
    assert 5 <= len(h) <= 20 and set(n) == {1}
    h, n = lm_scoring.frequent(counts.unionByName(counts.limit(3).select((F.col("h") + 1).alias("h"), F.lit(9).cast("long").alias("n"))), most=20)
    assert list(n[:3]) == [9, 9, 9] and len(h) <= 20


def test_lm_learns_held_out_text(spark):
    out = lm_scoring.op7_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert out.s > out.b


def test_resampling(spark, docs, labels, empty):
    keyed = quality_classifier.weighted(docs, quality_classifier.log_ratio(quality_classifier.model_counts(docs, labels.where("quality = 1 and toxic = 0").select("doc_id").distinct()))).cache()
    rows = [tuple(r) for r in keyed.collect()]
    for k in (0, 1, 7, len(rows), len(rows) + 5):
        chosen = quality_classifier.top_k(keyed, k, last=3).where("selected").collect()
        cut = sorted((r[3] for r in rows), reverse=True)[: max(k, 0)]
        assert sorted((r.sample_key for r in chosen), reverse=True)[: len(cut)] == cut and len(chosen) >= min(k, len(rows))
    out = quality_classifier.resampled(docs, labels)
    assert out.count() == docs.count() and out.where("selected").count() >= 1
    assert quality_classifier.resampled(empty, labels).count() == 0
    assert quality_classifier.resampled(docs, labels.limit(0)).where("not selected").count() == 0


def test_resampling_prefers_good_text(spark):
    out = quality_classifier.op1_quality_resampling(spark, "/root/testdata/sf0.01").join(common.table(spark, "/root/testdata/sf0.01", "labels").where("toxic = 0"), "doc_id")
    got = {r.quality: r.x for r in out.groupBy("quality").agg(F.avg(F.col("selected").cast("int")).alias("x")).collect()}
    assert got[1] > 0.9 and got[0] < 0.5


def test_mixing(spark, docs, labels, empty):
    out = mixing.mixed(docs, labels).cache()
    assert out.agg(F.sum("n_rows")).first()[0] == docs.count() and out.where("rate < 0").count() == 0
    assert all(abs(sum(r.p) - 1) < 1e-9 for r in out.collect())
    kept = mixing.mixture(docs, labels)
    assert set(docs.columns) < set(kept.columns)
    assert mixing.mixture(empty, labels).count() == 0 and mixing.mixed(docs, labels.limit(0)).count() == out.count()


def test_mixing_meets_targets(spark):
    rows = [(k, 1, 100 + k, [0.9, 0.1, 0.0] if k % 3 else [0.1, 0.2, 0.7]) for k in range(300)]
    members = spark.createDataFrame(rows, "doc_id long, n_rows long, tokens long, p array<double>")
    targets = {"good": 0.8, "poor": 0.12, "toxic": 0.08}
    steps = mixing.fit_rates(members, targets, 1.1)
    r = members.withColumn("r", mixing._rate(F.col("p"), steps)).agg(F.sum("tokens"), *(F.sum(F.col("tokens") * F.col("r") * F.col("p")[k]) for k in range(3))).first()
    assert [round(x / r[0], 2) for x in r[1:]] == pytest.approx([0.88, 0.132, 0.088], abs=0.02)


def test_toxic_documents_go(spark):
    sf = "/root/testdata/sf0.01"
    out = mixing.op8_mixing(spark, sf).join(common.table(spark, sf, "documents"), "doc_id")
    words = [r"idiot", "stupid", "worthless", "scum", "moron"]
    toxic = out.where(sum((F.col("text").contains(w).cast("int") for w in words), F.lit(0)) >= 3)
    assert toxic.count() > 5 and toxic.where("copies > 0").count() <= 0.1 * toxic.count()


def test_registry_is_complete():
    names = llm.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and set(llm.oracle_sql()) <= set(names)


def test_pipeline_stages_against_brute_force(spark):
    docs = common.table(spark, SF, "documents")
    bench = [(r.item_id, r.text) for r in common.table(spark, SF, "benchmark").collect()]
    rows = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "simhash_near_dedup", "decontaminate", "mixing"]
    step = lambda name, frame: common.written(stages[name](spark, frame, SF), name)
    read = lambda frame: {r.doc_id: r.text for r in frame.collect()}
    one = step("quality_rules", docs)
    got = read(one)
    assert set(got) <= {d for d, t in rows.items() if not brute.quality_base(t)[5]} and one.columns == docs.columns
    two = step("line_dedup", one)
    want = {d: t for d, _, _, t in brute.dedup_lines(list(got.items()))}
    got = read(two)
    assert got == want and two.columns == docs.columns
    three = step("simhash_near_dedup", two)
    reach = brute.components({d: brute.fingerprint(t, 5, 4) for d, t in got.items()}, 47)
    want = {d: t for d, t in got.items() if reach[d] == d}
    got = read(three)
    assert got == want and three.columns == docs.columns
    four = step("decontaminate", three)
    hits = brute.contaminated(list(got.items()), bench)
    want = {d: t for (d, t), h in zip(got.items(), hits) if not h[1]}
    got = read(four)
    assert got == want and four.columns == docs.columns
    five = stages["mixing"](spark, four, SF)
    assert set(read(five)) <= set(got) and set(docs.columns) < set(five.columns) and five.count() == five.select("doc_id").distinct().count()


def test_near_dedup_keeps_one_row_of_each_component(spark):
    """Unique texts stay whatever their id is: null, or that of another text."""
    text = lambda k: " ".join(f"{k}w{j}" for j in range(60))
    rows = [(None, text(1), "a"), (None, text(1), "b"), (None, text(2), "a"), (7, text(3), "a"), (7, text(4), "a"), (8, text(5), "a"), (9, text(5), "a"), (None, text(5), "a"), (8, text(5), "a"), (7, text(6), "a"), (6, text(6), "a")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = corpus_pipeline.near_duplicates(spark, frame.repartition(3), SF)
    assert kept.columns == frame.columns
    got = by_row((r.doc_id, r.text) for r in kept.collect())
    assert got == by_row([(None, text(1)), (None, text(2)), (7, text(3)), (7, text(4)), (8, text(5)), (6, text(6))])
    again = simhash_bk.representatives(frame.orderBy(F.desc("source"), "doc_id")).collect()
    assert by_row(map(tuple, again)) == by_row(map(tuple, kept.collect()))
    assert simhash_bk.representatives(frame.limit(0)).count() == 0


def test_edge_rows_keep_one_row_of_each_component(docs):
    fps = [brute.fingerprint(t, 5, 4) for _, t in edge_rows()]
    reach = brute.components(dict(enumerate(fps)), 47)
    assert simhash_bk.representatives(docs).count() == len(set(reach.values()))


def test_near_dedup_catches_edited_copies(spark):
    """Copies of similarity 0.8 to 0.95 go, unrelated texts and texts of similarity below 0.5 stay."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, near, far = [], set(), set()
    for k in range(150):
        base = [word() for _ in range(rng.choice([60, 200, 500]))]
        rows.append((k, " ".join(base)))
        edits = rng.sample(range(len(base)), max(1, len(base) // 60))
        rows.append((1000 + k, " ".join(word() if j in edits else w for j, w in enumerate(base))))
        rows.append((2000 + k, " ".join(base[: len(base) // 3] + [word() for _ in range(len(base))])))
        a, b = set(brute.shingles(rows[-3][1], 5)), set(brute.shingles(rows[-2][1], 5))
        (near if len(a & b) / len(a | b) >= 0.8 else set()).add(1000 + k)
        far.add(2000 + k)
    kept = {r.doc_id for r in simhash_bk.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(near) > 100 and len(near & kept) <= 0.05 * len(near)
    assert far <= kept and set(range(150)) <= kept


def test_hot_shard_is_cut_into_bounded_tasks(spark):
    """30,000 near copies of one text: shards are cut, each pair of pieces is a task of its own, and one component remains."""
    base = 0x0123456789ABCDEF
    rows = spark.range(1, 30_001).select(F.col("id").alias("node"), *(F.lit(base + w).bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64("id", F.lit(w)), F.lit(60)).cast("int"))).alias(c) for w, c in enumerate(simhash_bk.fp_names(4))))
    links = simhash_bk.shard_links(rows, 47, simhash_bk.sampled_masks(30_000)[:2], tree_rows=2_000)
    roots = simhash_bk.components(links)
    assert roots.select("root").distinct().count() <= 2 and roots.count() >= 0.6 * 30_000


@pytest.mark.parametrize("toxic", [3, 9, 40])
def test_toxic_rates_fall_to_zero_at_any_share(spark, toxic):
    """1000 documents of which 0.3 %, 0.9 % and 4 % of the tokens are toxic."""
    rows = [(k, 1, 100, [0.02, 0.01, 0.97] if k < toxic else [0.97, 0.03, 0.0] if k % 10 else [0.1, 0.9, 0.0]) for k in range(1000)]
    members = spark.createDataFrame(rows, "doc_id long, n_rows long, tokens long, p array<double>")
    rates = members.withColumn("r", mixing._rate(F.col("p"), mixing.fit_rates(members, {"good": 0.95, "poor": 0.05, "toxic": 0.0}, 1.0)))
    got = rates.groupBy((F.col("doc_id") < toxic).alias("toxic")).agg(F.min("r").alias("low"), F.max("r").alias("high")).collect()
    got = {r.toxic: (r.low, r.high) for r in got}
    assert got[True][1] < 0.05 and got[False][0] > 0


def test_posteriors_against_brute_force(spark, monkeypatch):
    """Bernoulli naive Bayes with the noise floor taken off, in plain Python."""
    import numpy as np

    monkeypatch.setattr(mixing, "G_LEAST", 8.0)
    monkeypatch.setattr(mixing, "COMMON", 0.6)
    rng = random.Random(5)
    kinds = {0: "apple pear plum", 1: "mud junk trash", 2: "vile nasty scum"}
    rows, labels = [], []
    for k in range(160):
        d = rng.choice([0, 0, 0, 1, 2])
        own = [w for w in kinds[d].split() if rng.random() < 0.7]
        rows.append((k, " ".join(own + [rng.choice("the of and a to".split()) for _ in range(8)])))
        if k % 4:
            labels.append((k, int(d == 0), int(d == 2)))
    rows += [(200, None), (201, ""), (0, rows[0][1]), (None, "apple vile")]
    docs, named = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    text = dict(rows)
    domain = {d: 2 if x else 0 if q else 1 for d, q, x in labels}
    held = {d: set((text[d] or "").lower().split()) for d in domain}
    many = np.array([sum(v == k for v in domain.values()) for k in range(3)], float)
    prior = (many + 1) / (many.sum() + 3)
    weight, start = {}, np.log(prior)
    for w in set().union(*held.values()):
        n = np.array([sum(w in held[d] for d in domain if domain[d] == k) for k in range(3)], float)
        g = sum(2 * x * math.log(x / (n.sum() * p)) for x, p in zip(n, prior) if x)
        if g >= 8 and n.sum() <= 0.6 * many.sum():
            s = (n + mixing.SHRINK * n.sum() / (many.sum() + 1)) / (many + mixing.SHRINK)
            weight[w], start = np.log(s / (1 - s)), start + np.log(1 - s)
    soft = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    floor = soft(start)
    rest = floor.argmax()

    def member(t):
        p = soft(start + sum((weight[w] for w in set((t or "").lower().split()) if w in weight), np.zeros(3)))
        out = np.maximum(p - floor, 0) / (1 - floor)
        out[rest] = 0
        out[rest] = 1 - out.sum()
        return out

    assert len(weight) >= 6
    got = mixing.posteriors(docs, named).collect()
    assert len(got) == len({(d, t or "") for d, t in rows}) and sum(r.n_rows for r in got) == len(rows)
    for r in got:
        t = "apple vile" if r.doc_id is None else text[r.doc_id]
        assert r.p == pytest.approx(member(t).tolist(), abs=1e-9) and r.tokens == len((t or "").split())


def test_rates_are_least_squares(spark):
    """Targets that can be met are met; with fewer cells than members, the residual that fit_rates sees is that of all members."""
    import numpy as np

    rng = np.random.default_rng(1)
    p = rng.dirichlet([2, 1, 0.5], 2000)
    rows = [(int(k), 1, int(n), x.tolist()) for k, (n, x) in enumerate(zip(rng.integers(0, 500, 2000), p))]
    members = spark.createDataFrame(rows, "doc_id long, n_rows long, tokens long, p array<double>")
    targets = {"good": 0.5, "poor": 0.3, "toxic": 0.2}
    rates = members.withColumn("rate", mixing._rate(F.col("p"), mixing.fit_rates(members, targets, 1.1)))
    out = {r.domain: r for r in mixing.reached(rates, targets, 1.1).collect()}
    total = sum(r[2] for r in rows)
    assert all(abs(r.reached - r.wanted) <= 2 * mixing.CLOSE * total for r in out.values())
    assert out["good"].held == pytest.approx(sum(r[2] * r[3][0] for r in rows))
    got = [r.rate for r in rates.collect()]
    assert min(got) >= 0


def test_clean_documents_stay_in_the_mix(spark):
    """Of documents labelled good and not toxic, all but a few in a hundred stay; see the README for the measured share."""
    sf = "/root/testdata/sf0.01"
    docs = quality_rules.filtered(common.table(spark, sf, "documents"))
    kept = corpus_pipeline.mix(spark, docs, sf).select("doc_id").distinct()
    good = common.table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("x")).where("q = 1 and x = 0")
    of = docs.join(good, "doc_id")
    assert of.join(kept, "doc_id", "left_semi").count() >= 0.95 * of.count()


def test_shared_folder_is_needed_on_a_cluster(monkeypatch):
    class Conf:
        def get(self, *a):
            return None

    class Context:
        master, applicationId = "local-cluster[2,1,1024]", "a"  # noqa: N815

    class Session:
        conf, sparkContext = Conf(), Context()  # noqa: N815

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_weights_of_resampling_against_brute_force(docs, labels):
    """Log ratios of hashed words and pairs, in plain Python."""
    from factgraph.llm.textkernel import mix

    import numpy as np
    import xxhash

    def buckets(text):
        h = [int(mix(np.array([xxhash.xxh64_intdigest(w.encode(), 1)], np.uint64))[0]) for w in brute.words((text or "").translate(brute.LOW))]
        pairs = [int(mix(np.array([(3 * a + b) % 2**64], np.uint64))[0]) for a, b in zip(h, h[1:])]
        return [x >> 49 for x in [*h, *pairs]]

    good = {8, 9}
    raw, target = Counter(), Counter()
    for d, text in edge_rows():
        raw.update(buckets(text))
        if d in good:
            target.update(buckets(text))
    q = quality_classifier
    r = lambda b: (raw[b] + q.SMOOTH) / (sum(raw.values()) + q.SMOOTH * q.BUCKETS)
    ratio = lambda b: math.log((target[b] + q.PRIOR * r(b)) / (sum(target.values()) + q.PRIOR) / r(b))
    want = by_row((d, len(buckets(t)), round(sum(map(ratio, buckets(t))), 6) + 0.0) for d, t in edge_rows())
    table = q.log_ratio(q.model_counts(docs, labels.where("quality = 1 and toxic = 0").select("doc_id").distinct()))
    assert by_row((r.doc_id, r.n_features, round(r.log_weight, 6) + 0.0) for r in q.weighted(docs, table).collect()) == want


EDGE = "doc_id long, text string, lang string, source string, n_chars long, __row string, __text string, part string, mix_rate double, words int"


def edge_table(spark, folder, rows):
    spark.createDataFrame(rows, EDGE).repartition(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"bench{k}" for k in range(12))), (None, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline_runs_on_nulls_repeats_and_clashing_names(spark, tmp_path):
    """Rows without an id, null texts, repeated rows, one id for several texts, and columns named like inner ones."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    prose = lambda: " ".join(["the of and to"] + [word() for _ in range(80)])
    row = lambda d, t: (d, t, "en", "s", len(t or ""), "r", "t", "p", 0.5, 7)
    texts = [prose() for _ in range(6)]
    leak = prose() + " " + " ".join(f"bench{k}" for k in range(12))
    rows = [row(1, texts[0]), row(1, texts[0]), row(1, texts[1]), row(None, texts[2]), row(None, texts[3]), row(2, texts[3]), row(3, None), row(None, None), row(4, ""), row(5, leak), row(6, texts[4] + " x"), row(7, texts[4])]
    out = corpus_pipeline.run(spark, edge_table(spark, tmp_path / "a", rows))
    got = by_row((r.doc_id, r.text) for r in out.collect())
    assert got == by_row([(1, texts[0]), (1, texts[1]), (None, texts[2]), (2, texts[3]), (6, texts[4] + " x")])
    assert {"doc_id", "text", "lang", "source", "n_chars", "part", "words", "mix_rate", "mix_copies"} <= set(out.columns)
    assert corpus_pipeline.run(spark, edge_table(spark, tmp_path / "b", [])).count() == 0
