"""Each operator against a brute-force version, on the small tables with awkward rows added."""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillmere.llm import components, decontamination, html_wrappers, licenses, mixing, pii, quality_model, quality_rules, queries, simhash, token_counts, warc
from quillmere.session import scratch_path, table
from tests.conftest import rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark, small):
    """Documents with nulls, empty and very long texts, repeated rows, and columns that clash with operators' own names."""
    d = table(spark, small, "documents")
    long = "Lorem ipsum dolor +1 (555) 123-4567 " * 6000
    odd = [
        (9001, None, None, None, None), (None, "no id here at all", "en", "src1", 5), (None, None, None, None, None), (9002, "", "", "", 0), (9003, " \n\t ", "en", "src0", 4),
        (9004, long, "en", "src0", len(long)), (9005, "One", "en", None, 3), (9006, "é ü É x@y.de z", "en", "src2", 9),
        (9007, "mail a@b.c_d@e.f or 1.2.3.4.5 and 300.1.1.1, 4111 1111 1111 1111, 4111-1111-1111-1112.", "en", "src2", 1),
        (9008, "intro\nReleased under the MIT License.\nmore. Licensed under CC BY-NC 4.0.", "en", "src3", 1),
    ]
    out = d.unionByName(spark.createDataFrame(odd, d.schema)).unionByName(d.where("doc_id < 6"))
    return out.withColumns({"id": F.lit(1), "k": F.lit(2), "size": F.lit("s"), "spans": F.lit("x"), "mark": F.lit(0)}).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def empty(df):
    return df.limit(0)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    found = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {k: 0 for k in range(1, 41)} | {k: 100 for k in range(101, 130)} | {201: 200}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_of_a_chain_that_once_took_more_rounds_than_allowed(spark):
    rng = np.random.default_rng(2)
    names = rng.permutation(3000).tolist()
    edges = list(zip(names, names[1:]))
    found = {r.root for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {0}


def brute_fingerprint(text, words=3):
    w = WORD.findall((text or "").translate(AZ))
    parts = [" ".join(w[k : k + words]) for k in range(len(w) - words + 1)] if len(w) > words else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash_links_all_pairs_in_the_radius(docs, texts):
    got = Counter((r.id, r.w0 % 2**64, r.component_id) for r in simhash.simhash_groups(docs, tile=16).collect())
    prints = [(i, brute_fingerprint(t)) for i, t in texts]
    distinct = sorted({p for _, p in prints})
    up = {p: p for p in distinct}

    def root(p):
        while up[p] != p:
            p = up[p]
        return p

    for a in distinct:
        for b in distinct:
            if a < b and (a ^ b).bit_count() <= 2:
                up[root(a)] = root(b)
    least = defaultdict(list)
    for i, p in prints:
        least[root(p)] += [i] * (i is not None)
    assert got == Counter((i, p, min(least[root(p)], default=None)) for i, p in prints)
    assert simhash.simhash_groups(empty(docs)).count() == 0


def test_simhash_tiles_cut_by_size_lose_no_near_copy(spark):
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(5000)]
    rows = []
    for g in range(30):
        base = [words[k] for k in rng.integers(0, 5000, 200)]
        for c in range(4):
            copy = list(base)
            for k in rng.integers(0, 200, c):
                copy[k] = "changed"
            rows.append((g * 10 + c, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = simhash.simhash_groups(df, words=5, bits=256, radius=51, distinct=True, ratio=0.8, tile=8, link_empty=False).collect()
    assert {r.id: r.component_id for r in found} == {i: i // 10 * 10 for i, _ in rows}


def test_quality_classifier_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    scored = quality_model.quality_scores(table(spark, d, "documents")).toPandas()
    labels = table(spark, d, "labels").toPandas()
    both = scored.merge(labels, left_on="id", right_on="doc_id")
    good, bad = both[both.quality == 1], both[both.quality == 0]
    assert good.kept.mean() >= 0.98 and (~bad.kept).mean() >= 0.9  # labels are not used in training


def brute_vote(t):
    """The ten labellers in plain Python, word by word: (bad votes, good votes)."""
    t = t or ""
    w = WORD.findall(t)
    n = max(1, len(w))
    lines = [x.rstrip(" \t\n\v\f\r") for x in t.split("\n") if WORD.search(x)]
    runs = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    inside = {p for k in range(len(w) - 4) if runs[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
    values = [
        sum(t.count(c) for c in "#*$%&|<>") / n, sum(x.isupper() and len(x) > 1 for x in w) / n, len(inside) / n, (len(lines) - len(set(lines))) / max(1, len(lines)),
        sum(x == "|" for x in w) / n, t.count("!") / n, sum(a == b for a, b in zip(w, w[1:])) / n, max(Counter(w).values(), default=0) / n,
        sum(x.isascii() and not any(c.isalpha() for c in x) for x in w) / n, sum(not x.endswith((".", "!", "?", ":", ";", "…", '"', "'", "»", ")")) for x in lines) / max(1, len(lines)),
    ]
    cast = [None if len(w) < least else "bad" if v > bad else "good" if v < good else None for v, (_, bad, good, least) in zip(values, quality_model.LABELLERS, strict=True)]
    return cast, values, w


def test_labellers_posteriors_and_scores_are_those_of_a_row_by_row_version(spark, small):
    d = table(spark, small, "documents")
    got = {r.id: r for r in quality_model.quality_scores(d).collect()}
    texts = {r.doc_id: r.text for r in d.collect()}
    cast = {i: brute_vote(t)[0] for i, t in texts.items()}
    for i in texts:
        assert got[i].n_bad_votes == cast[i].count("bad") and got[i].n_words == len(WORD.findall(texts[i] or ""))
    # expectation-maximisation over documents instead of patterns, in plain loops
    m = len(quality_model.LABELLERS)
    post = {i: ([0.0] + [(v == "bad") / c.count("bad") for v in c]) if c.count("bad") else [1.0] + [0.0] * m for i, c in cast.items()}
    for _ in range(50):
        odds = [[[1 + sum(post[i][c] for i in texts if cast[i][k] == v) for v in ("bad", "good")] for k in range(m)] for c in range(m + 1)]
        odds = [[[b / (b + g), g / (b + g)] for b, g in row] for row in odds]
        odds[0] = [[min(b, 0.005), 1 - min(b, 0.005)] for b, _ in odds[0]]
        share = [1 + sum(p[c] for p in post.values()) for c in range(m + 1)]
        share = [x / sum(share) for x in share]
        for i, votes in cast.items():
            like = [share[c] * np.prod([odds[c][k][0 if v == "bad" else 1] for k, v in enumerate(votes) if v]) for c in range(m + 1)]
            post[i] = [x / sum(like) for x in like]
    for i in texts:
        assert got[i].posterior == pytest.approx(1 - post[i][0], abs=1e-9)
    # the scorer again: all rows are its sample here, so training on the same soft labels gives the same scores
    rows = []
    for i, t in texts.items():
        _, values, w = brute_vote(t)
        n = max(1, len(w))
        x = Counter()
        for word, c in Counter(w).items():
            x[quality_model.hashed(b"w", word.lower().encode())] += 0.3 * c / n
            x[quality_model.hashed(b"s", quality_model.shape(word).encode())] += c / n
        for k, v in enumerate(values):
            x[quality_model.named(f"m{k}:{int(min(v, 4) * 20)}")] += 0.5
            x[quality_model.named(f"t{k}")] += min(v, 1.0)
        x[quality_model.named(f"n{len(w).bit_length()}")] += 0.3
        rows.append((i, np.array(list(x)), np.array(list(x.values()))))
    weights, bias = quality_model.train_scorer([(a, b) for _, a, b in rows], np.array([1 - post[i][0] for i, _, _ in rows]))
    for i, a, b in rows:
        assert got[i].score == pytest.approx(1 / (1 + np.exp(-(weights[a] @ b + bias))), abs=1e-4)
        assert got[i].kept == (got[i].score < 0.5)


def test_known_labeller_accuracies_are_recovered():
    rng = np.random.default_rng(11)
    m, n = len(quality_model.LABELLERS), 40_000
    reason = np.where(rng.random(n) < 0.8, -1, rng.integers(0, m, n))  # good, or bad for what labeller k looks for
    right = np.linspace(0.7, 0.97, m)
    cast = np.where(rng.random((n, m)) < 0.002, quality_model.BAD, quality_model.GOOD)
    for k in range(m):
        cast[reason == k, k] = np.where(rng.random((reason == k).sum()) < right[k], quality_model.BAD, quality_model.GOOD)
    cast[rng.random((n, m)) < 0.2] = quality_model.ABSTAIN
    patterns, counts = np.unique(cast, axis=0, return_counts=True)
    found = quality_model.expectation_maximisation(patterns, counts.astype(float))
    assert found["share"][0] == pytest.approx(0.8, abs=0.08)
    assert [found["odds"][1 + k, k, quality_model.BAD] for k in range(m)] == pytest.approx(right.tolist(), abs=0.3)
    assert (found["odds"][0, :, quality_model.BAD] <= 0.005 + 1e-9).all()
    sure = found["posterior"][[(p == quality_model.BAD).any() for p in patterns]]
    assert sure.min() > 0.5


def test_words_that_differ_after_64_characters_have_their_own_shapes():
    assert quality_model.shape("a" * 64 + "-" + "b" * 9) == "a-a" != quality_model.shape("a" * 64 + "_9")
    n, cast, index, counts, _ = quality_model.facts_of("x" * 10**6 + " y")
    assert n == 2 and counts.sum() == 4


def test_quality_classifier_takes_odd_rows(docs, texts):
    once = quality_model.quality_scores(docs).collect()
    assert len(once) == len(texts) and all(0 <= r.score <= 1 for r in once)
    again = quality_model.quality_scores(docs.repartition(7)).collect()
    assert Counter((r.id, round(r.score, 9)) for r in once) == Counter((r.id, round(r.score, 9)) for r in again)
    assert quality_model.quality_scores(empty(docs)).count() == 0


def test_warc_round_trip_over_small_ranges(spark, small, monkeypatch):
    pages = table(spark, small, "pages")
    big = "<p>" + "same " * 400
    odd = [(None, None, None), (5000, "u v", ""), (5001, "x", "\x1f short"), (6001, "a", big), (6003, "b", big), (6002, "c", big), (6003, "b", big), (None, "d", big)]
    pages = pages.unionByName(spark.createDataFrame(odd, pages.schema)).withColumn("digest", F.lit("clash"))
    archives = warc.write_warc(warc.plan_records(pages.repartition(3)), scratch_path(spark, "warc"), roll=10_000)
    assert archives.count() > 3
    records = warc.read_warc(archives, range_bytes=3001).collect()
    page_of = lambda x: int(x.rsplit(":", 1)[1]) if x and x.rsplit(":", 1)[1] else None
    got = Counter((page_of(r.record_id), r.record_type, page_of(r.refers_to), r.payload_bytes, r.payload_digest, None if r.payload is None else bytes(r.payload)) for r in records)
    want = Counter()
    rows = pages.select("page_id", "html").collect()
    first = defaultdict(int)
    for r in rows:
        if r.page_id is not None and len((r.html or "").encode()) >= 1000:
            first[r.html] = max(first[r.html], r.page_id)
    for r in rows:
        body = (r.html or "").encode()
        leader = first.get(r.html) if len(body) >= 1000 else None
        again = leader is not None and r.page_id != leader
        want[(r.page_id, "revisit" if again else "response", leader if again else None, len(body), hashlib.sha1(body).hexdigest(), None if again else body)] += 1
    assert got == want
    assert warc.read_warc(warc.write_warc(warc.plan_records(empty(pages)), scratch_path(spark, "warc"))).count() == 0
    tasks = warc.read_warc(archives, range_bytes=3001).groupBy(F.spark_partition_id()).count().count()
    assert tasks > 8  # ranges are read by many tasks
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    key = lambda df: Counter((r.page_id, r.url, bytes(r.payload), r.leader) for r in df.collect())
    shuffled = warc.plan_records(pages)
    monkeypatch.undo()
    assert key(shuffled) == key(warc.plan_records(pages))


def test_warc_reader_skips_what_is_no_record():
    import gzip
    import io

    good = warc.record(7, "http://x", b"\x1f\x8b\x08 inside", hashlib.sha1(b"\x1f\x8b\x08 inside").hexdigest(), None, "2024-01-01T00:00:00Z")
    data = b"junk\x1f\x8b\x08junk" + gzip.compress(b"other") + good + warc.MAGIC + b"cut"
    found = [x for s in range(0, len(data), 5) for x in warc.members(io.BytesIO(data), s, min(len(data), s + 5))]
    assert [warc.parse(d)["fields"]["warc-record-id"] for _, d in found] == ["<urn:page:7>"]


def test_licenses(docs, texts):
    rows = {r.doc_id: r for r in licenses.scan_licenses(docs).collect() if r.doc_id is not None}
    assert rows[9008].licenses == "CC-BY-NC-4.0,MIT" and rows[9008].spans.startswith("MIT:6:37,") and rows[9001].n_sentences == 0
    names = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0"}
    for i, t in texts:
        want = sorted({v for k, v in names.items() if any(line == k for line in re.split(r"\n", t or ""))})
        if i is not None and i < 9000:
            assert rows[i].licenses == ",".join(want)
    assert licenses.scan_licenses(empty(docs)).count() == 0


def test_license_sentences_may_be_wrapped_and_rules_take_the_longest_run():
    full = "\n\n".join(licenses.SENTENCES[k].replace(", ", ",\n") for k in ("mit.grant", "mit.notice", "mit.as-is"))
    assert [x[0] for x in licenses.match_rules(licenses.sentences("Copyright 2020 X\n\n" + full))] == ["MIT"]
    bsd = "\n".join(f"{k}. {licenses.SENTENCES[s]}" if k else licenses.SENTENCES[s] for k, s in enumerate(("bsd.grant", "bsd.source", "bsd.binary", "bsd.names")))
    assert [x[0] for x in licenses.match_rules(licenses.sentences(bsd))] == ["BSD-3-Clause"]
    assert licenses.sentences("the licence fee was paid") == []


def test_every_known_license_sentence_is_found_alone_and_a_word_a_line():
    for name, key in [("MIT", "MIT"), ("the Apache-2.0", "Apache-2.0"), ("the BSD-3-Clause", "BSD-3-Clause"), ("CC BY 4.0", "CC-BY-4.0")]:
        assert [x[0] for x in licenses.match_rules(licenses.sentences(f"Text.\nReleased under {name}.\nMore"))] == [key]
    for words, key in licenses.KNOWN.items():
        assert [x[0] for x in licenses.sentences(words)] == [key]
        assert [x[0] for x in licenses.sentences(words.replace(" ", "\n"))] == [key]
    assert licenses.sentences("-\n" * 100_000 + "MIT")[1:] == []


def test_mixing_meets_its_targets(spark, docs, texts):
    rows = mixing.mix_sources(docs, shards=5).collect()
    assert len(rows) == len(texts)
    taken = defaultdict(int)
    for r in rows:
        words = sum(d.words for d in r.draws)
        taken[r.source] += words
        assert r["size"] == len(WORD.findall(next(t for i, t in texts if i == r.doc_id) or "")) if r.doc_id is not None else True
        assert words <= 3 * r["size"] and all(0 <= d.shard < 5 for d in r.draws) and len({d.epoch for d in r.draws}) == len(r.draws)
    aims = {r.source: r.target for r in rows}
    assert all(abs(taken[s] - aims[s]) <= 0.5 for s in aims)
    assert sum(aims.values()) == pytest.approx(sum(r["size"] for r in rows))
    again = mixing.mix_sources(docs.repartition(11), shards=5).collect()
    key = lambda rs: Counter((r.doc_id, r["size"], tuple(map(tuple, r.draws))) for r in rs)
    assert key(rows) == key(again)
    assert mixing.mix_sources(empty(docs)).count() == 0 and mixing.mixture(mixing.mix_sources(docs)).count() > 0


def brute_targets(sizes, weights, cap=3.0):
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        left = sum(sizes) - sum(out[k] for k in range(len(sizes)) if k not in open_)
        level = left / sum(weights[k] for k in open_)
        over = [k for k in open_ if level * weights[k] > cap * sizes[k]]
        if not over:
            for k in open_:
                out[k] = level * weights[k]
            break
        for k in over:
            out[k] = cap * sizes[k]
            open_.discard(k)
    return out


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1, 100, 400], [0, 0], [5], [3, 0, 9, 1000, 2, 2, 7], list(range(40)), [10**12, 1, 5 * 10**11]])
def test_targets_are_those_of_refilling_by_hand(spark, sizes):
    rows = spark.createDataFrame([(None if k == len(sizes) - 1 else f"s{k:03d}", 1, n) for k, n in enumerate(sizes)], "source string, n long, size long").repartition(3)
    got = {r.source: r for r in mixing.source_targets(rows, (1, 2, 3), 3.0).collect()}
    want = brute_targets(sizes, [1 + k % 3 for k in range(len(sizes))])
    for k, n in enumerate(sizes):
        r = got[None if k == len(sizes) - 1 else f"s{k:03d}"]
        assert (r.place, r["size"]) == (k, n) and r.target == pytest.approx(want[k])
    assert mixing.source_targets(rows.limit(0), (1, 2, 3), 3.0).count() == 0


def test_quotas_are_dealt_exactly_in_groups_too(spark, monkeypatch):
    q = mixing.split_quotas([1000, 10, 0, 333], 7, 3)
    assert q.sum(axis=0).tolist() == [1000, 10, 0, 333] and q.sum(axis=1).max() - q.sum(axis=1).min() <= 3
    assert (q == mixing.split_quotas([1000, 10, 0, 333], 7, 3)).all()
    monkeypatch.setattr(mixing, "GROUP", 4)
    quotas = [(f"s{k}", k, (k * 37) % 101) for k in range(30)]
    dealt = {r.key: np.diff([0, *r.shard_ends]) for r in mixing.shard_shares(spark.createDataFrame(quotas, "key string, place long, quota long"), 5, 9).collect()}
    assert {k: x.sum() for k, x in dealt.items()} == {k: n for k, _, n in quotas} and all((x >= 0).all() for x in dealt.values())
    per_shard = sum(dealt.values())
    assert per_shard.max() - per_shard.min() <= 3


def test_mixing_many_sources_small_blocks_null_ids_and_clashing_names(spark, monkeypatch, tmp_path):
    rows = [(None if k % 3 == 0 else k, f"w{k} " * (k % 17), None if k % 50 == 0 else f"src{k % 50}", k) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int").withColumns({"key": F.lit("x"), "mark": F.lit(1), "draws": F.lit(2)})
    monkeypatch.setattr(mixing, "GROUP", 8)
    found = mixing.mix_sources(docs, block_docs=4, keep=("size", "key")).collect()
    per = defaultdict(int)
    for r in found:
        per[r.source] += sum(d.words for d in r.draws)
        assert r.kept_size % 50 == (0 if r.source is None else int(r.source[3:])) and r.key == "x"
    names = sorted({r.source for r in found} - {None}) + [None]
    sizes = [sum(r["size"] for r in found if r.source == s) for s in names]
    for s, aim in zip(names, brute_targets(sizes, [1 + k % 3 for k in range(len(names))]), strict=True):
        assert abs(per[s] - aim) <= 0.5
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 30)  # blocks grow instead of a draw beyond what numpy can
    assert sum(d.words for r in mixing.mix_sources(docs).collect() for d in r.draws) == pytest.approx(sum(per.values()), rel=0.01)
    mixed = mixing.mixture(mixing.mix_sources(docs))
    mixing.write_shards(mixed, f"{tmp_path}/shards")
    again = spark.read.parquet(f"{tmp_path}/shards")
    assert again.count() == mixed.count() and again.agg(F.sum("words")).first()[0] == mixed.agg(F.sum("words")).first()[0]


def plain_article(page):
    inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    parts = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(p for p in parts if p)


def test_html_text_of_the_test_pages(spark, small):
    pages = table(spark, small, "pages")
    pages = pages.unionByName(spark.createDataFrame([(900, None, None), (901, "x", ""), (902, "http://q.org", "no tags &amp; all")], pages.schema)).withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in html_wrappers.extract_main_text(pages).collect()}
    for r in pages.where("page_id < 900").collect():
        assert got[r.page_id].text == plain_article(r.html) and got[r.page_id].n_chars == len(plain_article(r.html))
    assert got[900].text == got[901].text == "" and got[902].text == "no tags & all"
    assert html_wrappers.extract_main_text(empty(pages)).count() == 0


def test_wrappers_drop_what_surrounds_an_article(spark):
    def page(k):
        return f"""<!doctype html><body class="home"><div id="cookie-notice">We use cookies</div><header><h1>Site</h1></header><div class="wrap"><h2>Title {k}</h2>
        <p>First <b>bold</b>{k}<p>Second&nbsp;{k}<ul><li>a{k}<li>b</ul>{'<blockquote>Q' + str(k) + '</blockquote>' if k % 2 else ''}<p class=share-bar>Share this</p><p>Read our terms.</p>
        <div class="sidebar"><p>side {k}</p></div><table><tr><td>1{k}<td>2</table></div><form>q<input></form><section class="reader-comments"><p>nice {k}</p></section>
        <script>if (a<b) "</p>"</script><div class="promo ad-slot">Buy {k}</div></body>"""

    rows = [(k, f"https://site.example/{k}", page(k)) for k in range(8)]
    got = {r.page_id: r.text for r in html_wrappers.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(8):
        quote = [f"Q{k}"] if k % 2 else []
        assert got[k].split("\n\n") == [f"Title {k}", f"First bold{k}", f"Second {k}", f"a{k}", "b", *quote, f"1{k}", "2"]


def test_blocks_of_an_article_stay_whatever_they_are_called_and_templates_in_it_go(spark):
    def page(k, notice):
        return f"""<body><div class="login-box"><p>Log in</p></div><article><div class="article-header"><h1>Title {k}</h1></div><p>Body {k}.</p><p class="share-price">Shares rose {k}</p>
        <section class="login-guide"><p>How to log in {k}</p></section>{'<div><p>Sign our petition.</p></div>' if notice else ''}<h2>Sources</h2><div class="ad">Buy {k}</div><p id="comment-policy">Policy {k}</p></article>"""

    rows = [(k, f"https://n.example/{k}", page(k, True)) for k in range(8)] + [(20 + k, f"https://few.example/{k}", page(k, True)) for k in range(3)] + [(30, "https://one.example/", page(0, False))]
    got = {r.page_id: r.text.split("\n\n") for r in html_wrappers.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    blocks = lambda k, more: [f"Title {k}", f"Body {k}.", f"Shares rose {k}", f"How to log in {k}", *more, "Sources", f"Policy {k}"]
    assert all(got[k] == blocks(k, []) for k in range(8)) and all(got[20 + k] == blocks(k, ["Sign our petition."]) for k in range(3)) and got[30] == blocks(0, [])
    off = {r.page_id: r.text for r in html_wrappers.extract_main_text(spark.createDataFrame(rows[:8], "page_id long, url string, html string"), evidence=10**9).collect()}
    assert all("petition" in off[k] for k in range(8))


def test_copies_and_headings_within_an_article_are_no_template(spark):
    own = "<div><p>Long story</p><p>of one page</p><blockquote>Only here</blockquote></div>"
    rows = [(k, "https://a.example/same", own) for k in range(6)] + [(10 + k, f"https://a.example/{k}", f"<div><p>Story {k}</p><p>part {k}</p></div>") for k in range(6)]
    rows += [(20 + k, f"https://b.example/{k}", f"<article><h2>Ingredients</h2><p>Flour {k}</p></article>") for k in range(6)]
    rows += [(30 + k, f"https://c.example/{k}", f"<div><p>Text {k}</p><blockquote>Same below each</blockquote></div>") for k in range(6)]
    got = {r.page_id: r.text for r in html_wrappers.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(6):
        assert got[k] == "Long story\n\nof one page\n\nOnly here" and got[10 + k] == f"Story {k}\n\npart {k}"
        assert got[20 + k] == f"Ingredients\n\nFlour {k}" and got[30 + k] == f"Text {k}"


def test_wrapper_inference_finds_optional_and_repeated_groups():
    trees = [html_wrappers.written(html_wrappers.parse(x)[0]) for x in ("<h1>a</h1><p>b<p>c", "<h1>a</h1><ul><li>x<li>y</ul><p>b")]
    wrapper, maps = html_wrappers.infer(trees)
    assert wrapper == "/ 3 h1 1 # 0 ul ?1 li +1 # 0 p +1 # 0"
    assert maps == [[0, 2], [0, 1, 2]]
    assert html_wrappers.written(html_wrappers.read(wrapper)[0]) == wrapper


def made_page(rng, host, tagged):
    """A page of a site and its article's blocks, known from how it was made. Sites name no parts; only wrappers tell them."""
    say = lambda n: " ".join(f"w{rng.integers(10**6)}" for _ in range(n))
    blocks, parts = [], []
    for _ in range(rng.integers(1, 7)):
        kind = ["p", "h2", "ul", "table", "blockquote", "pre"][rng.integers(6)]
        if kind == "ul":
            items = [say(3) for _ in range(rng.integers(1, 4))]
            parts.append("<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>")
            blocks += items
        elif kind == "table":
            cells = [say(2) for _ in range(4)]
            parts.append("<table><tr><td>{}<td>{}<tr><td>{}<td>{}</table>".format(*cells))
            blocks += cells
        else:
            words = say(rng.integers(1, 9)).split()
            parts.append(f"<{kind}>" + " \n".join(f"<b>{w}</b>" if rng.integers(4) == 0 else w for w in words) + f"</{kind}>")
            blocks.append(" ".join(words))
    inner = "".join(parts)
    inner = f"<article>{inner}</article>" if tagged else f"<div><div>{inner}</div></div>"
    links = "".join(f'<li><a href="/{k}">{say(2)}</a></li>' for k in range(4))
    before = [f"<section><h5>{host} daily</h5><h6>all rights</h6></section>", f"<ol>{links}</ol>"]
    after = [f"<dl><dt>Find {host} here<dd>Street 1</dl>", "<script>x('<p>no</p>')</script>", "<form>Your name <input></form>"]
    return "<html><head><title>t</title></head><body>" + "".join(before) + inner + "".join(x for x in after if rng.integers(4)) + "</body>", blocks


def test_html_text_of_made_pages_comes_from_the_wrappers(spark):
    rng, rows, want = np.random.default_rng(5), [], {}
    for k in range(240):
        page, blocks = made_page(rng, f"h{k % 6}", k % 6 < 2)
        rows.append((k, f"https://h{k % 6}.example/{k}", page))
        want[k] = "\n\n".join(blocks)
    rows += [(1000 + i, u, p) for i, u, p in rows[:30]]  # repeated pages
    want |= {1000 + k: want[k] for k in range(30)}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "slots": F.lit(2), "mark": F.lit(3)})
    texts = lambda **o: {r.page_id: r.text for r in html_wrappers.extract_main_text(pages, **o).collect()}
    assert texts() == want
    assert texts(fold_at_once=8) == want  # however the skeletons of a host are grouped
    off = texts(evidence=10**9)  # without what the wrappers know, template text stays on all pages without an article element
    assert {k for k in want if off[k] != want[k]} == {k for k in want if k % 1000 % 6 >= 2}


def test_deep_broken_and_very_long_pages_take_linear_time(spark):
    n = 100_000
    odd = ["<div>" * n + "deep" + "</div>" * n, "<div>x" * n, "<a " * 330_000, '<a =">"' * 150_000, "<p>kept" + "<script " * n, "<ul>" + "<li><p>a<b>x</b>" * 50_000, "<div>" * 50_000 + "<dt>a</dt>" * 50_000, "&" * 10**6, "<!--" * n, "a" * 3 * 10**6]
    rows = [(k, f"http://odd.example/{k}", p) for k, p in enumerate(odd)]
    got = {r.page_id: r.text for r in html_wrappers.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "deep" and got[1].count("x") == n and got[4].startswith("kept") and got[5].count("ax") == 50_000 and got[6].count("a") == 50_000
    assert got[7] == odd[7] and got[8] == "" and got[9] == odd[9]


def brute_statistics(t):
    w = WORD.findall(t or "")
    runs = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    inside = {p for k in range(len(w) - 4) if runs[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(inside)


def test_quality_rules(spark, small, docs, texts):
    labels = table(spark, small, "labels")
    rows = quality_rules.quality_rules(docs, labels).collect()
    got = Counter((r.id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    want = Counter()
    for i, t in texts:
        s = brute_statistics(t)
        want[(i, *s, s[0] < 10 or 100 * s[4] > 20 * s[0])] += 1
    assert got == want and not any(r.kept and r.base_failed for r in rows)
    marks = {r.doc_id: r.quality for r in labels.collect()}
    good = [r for r in rows if marks.get(r.id) == 1 and not r.base_failed]
    assert sum(r.kept for r in good) >= 0.98 * len(good)
    assert all(r.kept != r.base_failed for r in quality_rules.quality_rules(docs, None).collect())
    assert quality_rules.quality_rules(empty(docs), labels).count() == 0


def test_quality_rules_reject_bad_rows_whose_labels_they_have_not_seen(spark):
    d = "/root/testdata/sf0.01"
    labels = table(spark, d, "labels")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    rows = quality_rules.quality_rules(table(spark, d, "documents"), labels.where(half)).collect()
    unseen = {r.doc_id: r.quality for r in labels.where(~half).collect()}
    good, bad = [r for r in rows if unseen.get(r.id) == 1], [r for r in rows if unseen.get(r.id) == 0]
    judged = [r for r in bad if not r.base_failed]
    assert sum(r.kept for r in good) >= 0.97 * len(good) and len(bad) > 20
    assert sum(not r.kept for r in bad) >= 0.9 * len(bad) and sum(not r.kept for r in judged) >= 0.8 * len(judged)


def test_isolation_forest_scores_a_lone_row_high():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(500, 2)), [[12, 12]]])
    forest = [quality_rules.grow(x[rng.choice(501, 128, replace=False)], rng, 7) for _ in range(50)]
    s = quality_rules.forest_scores(forest, 128, x)
    assert s.argmax() == 500 and s[500] > 0.6 > np.median(s)


def test_token_counts(docs, texts):
    encode = token_counts.encoder(queries.VOCABULARY).encode_ordinary
    n = sorted(len(encode(t)) if t else 0 for _, t in texts)
    rows = token_counts.token_counts(docs, queries.VOCABULARY).collect()
    assert sorted(r.context_limit for r in rows) == sorted(set(n))
    for r in rows:
        k = r.context_limit
        assert (r.n_docs, r.docs_longer, r.tokens_kept, r.tokens_lost) == (n.count(k), sum(x > k for x in n), sum(min(x, k) for x in n), sum(max(0, x - k) for x in n))
        assert r.share_within == pytest.approx(sum(x <= k for x in n) / len(n))
    assert token_counts.token_counts(empty(docs), queries.VOCABULARY).count() == 0


def test_length_report_equals_its_sql(spark, duck):
    rng = np.random.default_rng(3)
    n = [int(x) for x in rng.geometric(0.002, 4000)] + [0] * 7 + [10**6] * 2 + [500] * 3000  # a third of all rows are of one length
    got = token_counts.length_report(spark.createDataFrame([(x,) for x in n], "n_tokens long")).toPandas()
    duck.execute("CREATE OR REPLACE TEMP TABLE lengths AS SELECT unnest(?::BIGINT[]) AS n", [n])
    want = duck.execute("""WITH h AS (SELECT n, count(*) AS c FROM lengths GROUP BY n)
      SELECT n AS context_limit, c AS n_docs, cast((SELECT coalesce(sum(c), 0) FROM h b WHERE b.n > a.n) AS BIGINT) AS docs_longer,
             cast((SELECT sum(c * least(b.n, a.n)) FROM h b) AS BIGINT) AS tokens_kept, cast((SELECT sum(c * greatest(b.n - a.n, 0)) FROM h b) AS BIGINT) AS tokens_lost,
             (SELECT sum(c) FROM h b WHERE b.n <= a.n) / (SELECT sum(c) FROM h)::DOUBLE AS share_within FROM h a""").df()
    assert rows_of(got) == rows_of(want)


def test_decontamination(spark, small, docs, texts):
    items = table(spark, small, "benchmark")
    short = next(t for i, t in texts if i == 3).split()[5]
    items = items.unionByName(spark.createDataFrame([(900, short), (901, None), (902, " \n"), (None, "One"), (903, "lorem ipsum dolor 1 555 123 4567 lorem ipsum dolor 1 555")], items.schema)).withColumn("term", F.lit(0))
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    windows = defaultdict(set)
    for r in items.collect():
        w = find((r.text or "").translate(AZ))
        size = min(10, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[k : k + size])].add("" if r.item_id is None else str(r.item_id))
    want = Counter()
    for i, t in texts:
        w = find((t or "").translate(AZ))
        hit, found = set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
                    found |= windows[tuple(w[k : k + size])]
        want[(i, len(w), len(hit), tuple(sorted(found)))] += 1
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontamination.decontaminate(docs, items).collect())
    assert got == want and sum(n for k, n in got.items() if k[2]) > 3
    assert decontamination.decontaminate(empty(docs), items).count() == 0
    assert decontamination.decontaminate(docs, empty(items)).where("n_hit > 0").count() == 0


def test_proximity_finds_a_phrase_with_a_changed_word(spark):
    docs = spark.createDataFrame([(1, "x a b c d e f g h zz j y"), (2, "a b q r s t u v")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    assert [(r.at, r.n_near) for r in decontamination.proximity(docs, items).collect()] == [(1, 9)]


def test_proximity_equals_a_comparison_of_all_windows(spark):
    rng = np.random.default_rng(8)
    say = lambda n: [f"w{min(rng.geometric(0.05), 90)}" for _ in range(n)]
    items = [(i, say(n)) for i, n in enumerate([10, 14, 25, 6, 1, 12])]
    docs = []
    for k in range(40):
        body = say(60)
        part = list(items[k % 6][1])
        for x in rng.integers(0, len(part), k % 4):
            part[x] = "changed"
        docs.append((k, body[:20] + part + body[20:]))
    want = set()
    for d, text in docs:
        at_of = {}
        for i, words in items:
            w = min(10, len(words))
            for s in range(len(words) - w + 1):
                for p in range(-w + 1, len(text)):
                    n = sum(0 <= p + j < len(text) and text[p + j] == words[s + j] for j in range(w))
                    if n >= max(1, w - 2):
                        at_of[i, p - s] = max(n, at_of.get((i, p - s), 0))
        want |= {(d, str(i), at, n) for (i, at), n in at_of.items()}
    table_ = lambda rows, name: spark.createDataFrame([(i, " ".join(w)) for i, w in rows], f"{name} long, text string")
    d = table_(docs, "doc_id")
    key = d.select("doc_id", F.xxhash64("doc_id", "text").alias("k"))
    lead = {r.k: r.doc_id for r in key.collect()}
    got = {(lead[r.k], r.item_id, r.at, r.n_near) for r in decontamination.proximity(d, table_(items, "item_id")).collect()}
    assert got == want and len(want) > 30


RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def allowed(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        odd = [int(c) for c in digits[::-1]]
        return 16 <= len(digits) <= 19 and sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(odd)) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def test_pii_base_spans(docs, texts):
    rows = pii.find_pii(docs).select("doc_id", "text", "pii_spans", pii.sanitised("text", "pii_spans").alias("clean"), "id", "k").collect()
    got = Counter((r.doc_id, r.text, tuple((s.kind, s.start, s.end) for s in r.pii_spans if s.kind != "term")) for r in rows)
    want = Counter((i, t, tuple((k, m.start(), m.end()) for k, p in RULES.items() for m in re.finditer(p, t or "") if allowed(k, m[0]))) for i, t in texts)
    assert got == want and {r.id for r in rows} == {1}
    clean = {r.doc_id: r.clean for r in rows}
    assert clean[9001] is None and clean[9007] == "mail [EMAIL][EMAIL] or [IP].5 and 300.1.1.1, [CARD], 4111-1111-1111-1112."
    assert pii.find_pii(empty(docs)).count() == 0


def test_pii_search_is_linear_in_long_runs(spark):
    t = spark.createDataFrame([(1, "a" * 300_000), (2, "1" * 300_000), (3, "x@" + "a." * 20_000 + "b"), (4, "1-" * 100_000)], "doc_id long, text string")
    assert [len(r.pii_spans) for r in pii.find_pii(t).orderBy("doc_id").collect()] == [0, 0, 1, 0]


def test_terms_that_reveal_an_entity_are_found_everywhere(spark):
    rows = [(k, f"filler words number{k} here and agent Zorblax writes zed@x.org again {'pad ' * k}") for k in range(4)]
    rows += [(9, "elsewhere Zorblax appears alone"), (10, "mail q@x.org and agent")] + [(20 + k, f"agent filler words here and writes again plain text {k}") for k in range(200)]
    found = {r.doc_id: r.pii_spans for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s.kind, s.value) for s in found[9]] == [("term", "Zorblax")]
    assert [(s.kind, s.value) for s in found[0]] == [("email", "zed@x.org"), ("term", "Zorblax")]
    assert [s.kind for s in found[10]] == ["email"] and not found[25]


def test_terms_far_away_and_beyond_120_characters_count_as_holding_the_entity(spark):
    far = "plain " + "word " * 60
    rows = [(k, f"{'q' * 200} Zorblax {'r' * 200} zed@x.org and {k} more") for k in range(4)] + [(4, f"Zorblax {far} zed@x.org"), (5, f"zed@x.org {far} Zorblax {far}")]
    rows += [(20 + k, f"other {far} words {k}") for k in range(200)]
    rows += [(300 + k, f"写信给 李雷 li@y.cn 谢谢{k}") for k in range(4)]
    found = {r.doc_id: r.pii_spans for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k in range(6):
        assert "Zorblax" in [s.value for s in found[k] if s.kind == "term"]
    assert "李雷" in [s.value for s in found[300] if s.kind == "term"] and not found[25]


def test_mention_contexts_are_linear_in_long_texts(spark):
    t = spark.createDataFrame([(1, "10.0.0.1 " * 60_000), (2, "word " * 200_000 + "a@b.cd"), (3, "1234567 +1 555 123 4567 " * 20_000)], "doc_id long, text string")
    assert [len([s for s in r.pii_spans if s.kind != "term"]) for r in pii.find_pii(t).orderBy("doc_id").collect()] == [60_000, 1, 20_000]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, duck, small, name):
    ours = queries.queries()[name](spark, small).toPandas()
    theirs = duck.execute(queries.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and rows_of(ours) == rows_of(theirs)
