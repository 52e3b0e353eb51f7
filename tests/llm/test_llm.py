"""Each operator against a plain model on a small table with nulls, empty and long texts, copies, ties and other columns."""

import base64
import collections
import gzip
import hashlib
import itertools
import random
import time
import zlib
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from veilwork.llm import bpe, classifier, extraction, licences, media, packing, queries, rules, shingles, simhash, suffixes, warc

SF = "/root/testdata/sf0.001"
random.seed(11)
WORDS = ["the", "stone", "river", "Naïve", "über", "日本", "mit", "license", "x1", "don't", "!!", "#tag"]
LONG = " ".join(random.choice(WORDS) + str(random.randint(0, 400)) for _ in range(6000))
PASSAGE = " ".join(f"shared{i}" for i in range(40))
TEXTS = [
    None, "", " ", "\n\t ", "one", "one", "Two words", "a b c d e a b c d e a b c d e", LONG, LONG, LONG.replace("stone", "brick", 3),
    f"before {PASSAGE} after", f"other start {PASSAGE} other end", PASSAGE + " " + PASSAGE, "line one here\nline one here\nline two\n\nline one here",
    "Released under the MIT License.", "GNU General Public License version 3, or the Apache License", "CC BY cc by CC-BY", "mit  license\n", "é" * 700, "   lead  double   ", "a\x1cb 　c",
]
DOCS = [(i, t, "en", f"s{i % 3}", len(t) if t else None) for i, t in enumerate(TEXTS)] + [(None, "no id here", None, None, None), (5, "one", "en", "s2", 3)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).withColumns({c: F.lit(1) for c in ("print", "score", "failed", "spans", "key", "keys", "kept")}).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return [r.asDict() for r in df.collect()]


# --- WARC

PAGES = [(3, "u3", "<p>" + "x" * 200), (1, None, "<p>" + "x" * 200), (7, "u\r\n7", "<p>" + "x" * 200), (2, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (None, "n", "<p>" + "x" * 200), (1, "u1", "<p>" + "x" * 200), (8, "ü", "é" * 5000)]


def test_warc(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    found = warc.read_archives(warc.write_archives(pages))
    expected = collections.Counter()
    for page, _, html in PAGES:
        data = (html or "").encode()
        again = len(data) >= 100 and sum(h == html for _, _, h in PAGES) > 1 and page != min(p for p, _, h in PAGES if h == html and p is not None)
        expected[(page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 1 if again else None)] += 1
    got = found.collect()
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected
    assert {bytes(r.payload) for r in got if r.page_id == 8} == {("é" * 5000).encode()}
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_warc_framing_and_digest():
    record = warc.encode_record(1, "u", "response", None, b"payload", hashlib.sha256(b"payload").hexdigest())
    assert [r["payload"] for r in warc.read_records(record + record)] == [b"payload"] * 2
    bad = warc.encode_record(1, "u", "response", None, b"payload", hashlib.sha256(b"other").hexdigest())
    for data in (bad, record[:-3]):
        with pytest.raises(warc.BadRecord):
            list(warc.read_records(data))


def _foreign(fields, block, end=b"\r\n\r\n", version=b"WARC/1.0"):
    return gzip.compress(version + b"\r\n" + b"".join(b"%s: %s\r\n" % (k.encode(), v.encode()) for k, v in fields) + b"Content-Length: %d\r\n\r\n" % len(block) + block + end)


def test_warc_of_others(spark):
    body = b"<p>hello"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: 8\r\n\r\n"
    sha1 = base64.b32encode(hashlib.sha1(body).digest()).decode()
    usual = [("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Date", "2020-01-01T00:00:00Z")]
    response = [("WARC-Type", "response"), *usual, ("WARC-Target-URI", "http://a.example/"), ("content-type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{sha1}")]
    archive = _foreign([("WARC-Type", "warcinfo"), *usual, ("Content-Type", "application/warc-fields")], b"software: x\r\n") + _foreign(response, http + body) + _foreign([("WARC-Type", "resource"), *usual], body) + _foreign([("WARC-Type", "revisit"), *usual, ("Content-Type", "application/http")], http)
    got = rows(warc.read_archives(spark.createDataFrame([("x.warc.gz", bytearray(archive))], "path string, content binary")))
    digest = hashlib.sha256(body).hexdigest()
    assert [(r["record_type"], r["url"], r["payload_bytes"], r["payload_digest"]) for r in got][1:] == [("response", "http://a.example/", 8, digest), ("resource", None, 8, digest), ("revisit", None, 8, None)]
    assert got[0]["record_type"] == "warcinfo" and bytes(got[1]["payload"]) == body and got[3]["payload"] is None and all(r["page_id"] is None for r in got)
    for bad in (_foreign(response, http + b"other"), _foreign(usual, body), _foreign(response, http + body, b""), b"no gzip at all", _foreign(response, http + body)[:-9], gzip.compress(b"WARC/1.0\r\nWARC-Type: response\r\n\r\nx\r\n\r\n"), _foreign(response, http + body, version=b"HTTP/1.1")):
        with pytest.raises(warc.BadRecord):
            list(warc.read_records(bad))


def test_warc_headers():
    record = zlib.decompress(warc.encode_record(7, "http://a.example/", "revisit", 3, b"x" * 200, "ab" * 32), 31).decode()
    for name in ("WARC-Record-ID: <urn:uuid:", "WARC-Date: ", "WARC-Type: revisit", "WARC-Refers-To: <urn:uuid:", "WARC-Profile: ", "WARC-Payload-Digest: sha256:"):
        assert name in record
    assert warc._record_id("response", 3, "ab" * 32) in record


# --- BPE


@pytest.fixture(scope="module")
def ranks():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@pytest.fixture(scope="module")
def reference(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_documents(docs, empty, reference):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    got = rows(bpe.encode_documents(docs, path, public_tokenizers.PATTERN))
    digests = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows(bpe.encode_documents(docs, path, public_tokenizers.PATTERN, digests=True))}
    assert len(got) == len(DOCS)
    assert sorted(((r["doc_id"] or -1, r["ids"], r["decoded"]) for r in got)) == sorted((d[0] or -1, reference.encode_ordinary(d[1] or ""), d[1] or "") for d in DOCS)
    for d in DOCS:
        ids = reference.encode_ordinary(d[1] or "")
        assert (d[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((d[1] or "").encode()).hexdigest()) in digests
    assert bpe.encode_documents(empty, path, public_tokenizers.PATTERN).count() == 0


def test_bpe_random(ranks, reference, monkeypatch):
    monkeypatch.setattr(bpe, "STEPS", 300)
    monkeypatch.setattr(bpe, "PAIRS", 50)
    own = bpe.Codec(ranks, public_tokenizers.PATTERN)
    parts = [" ", "  ", "\n", "\t", "a", "é", "日本", "🎉", "'s", "1", "23", "!!", "the", "ing", " 　", "\x1c", "q" * 9, "aaa", "----"]
    for _ in range(2000):
        text = "".join(random.choices(parts, k=random.randint(0, 14)))
        assert own.encode(text) == reference.encode_ordinary(text)
        assert "".join(own.decode(np.array(own.encode(text), int), step=3)) == text
    texts = ["".join(random.choices([*parts, "word", " other", "x" * 300], k=random.randint(0, 60))) for _ in range(200)] + [None, "", "é" * 2000]
    for size in (0, 12, 10_000):  # side by side, or one by one
        monkeypatch.setattr(bpe, "SIDE_BY_SIDE", size)
        own = bpe.Codec(ranks, public_tokenizers.PATTERN)
        ids, starts = own.encode_column(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [reference.encode_ordinary(t or "") for t in texts]


def test_bytes_that_are_no_utf8(spark):
    bad = spark.sql("SELECT 1L AS doc_id, CAST(x'61ff62' AS STRING) AS text UNION ALL SELECT 2L, 'ok'")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    assert {r["doc_id"]: r["decoded"] for r in rows(bpe.encode_documents(bad, path, public_tokenizers.PATTERN))} == {1: "a\ufffdb", 2: "ok"}
    assert packing.pack_documents(bad, public_tokenizers.path("word_bpe_49k.json")).filter("doc_id = 1").count() > 0
    page = bad.selectExpr("doc_id page_id", "'u' url", "concat('<article><p>', text) html")
    assert {r["page_id"]: r["text"] for r in rows(extraction.extract(page))} == {1: "a\ufffdb", 2: "ok"}


def test_bpe_pairs_by_merging(ranks):
    own = bpe.Transducer(ranks)
    tokens = random.sample(sorted(own.tokens), 3000)
    for a, b in zip(tokens, tokens[1:]):
        if own._follows(-1, a) and own._follows(-1, b):
            assert own._follows(a, b) == (own.merged(own.tokens[a] + own.tokens[b]) == [a, b])


def test_utf8_stream():
    stream, data = bpe.Utf8Stream(), "aé日🎉".encode()
    assert "".join(stream.feed(data[i : i + 1]) for i in range(len(data))) + stream.feed(b"", True) == "aé日🎉"
    assert bpe.Utf8Stream().feed(b"\xe6", final=True) == "�"


# --- media


def test_media(docs, empty):
    got = rows(media.fingerprints(media.media_column(docs)))
    assert len(got) == len(DOCS) and media.fingerprints(media.media_column(empty)).count() == 0
    model = {(d[0], hashlib.sha256(media.padded((d[1] or "").encode())).hexdigest(), len((d[1] or "").encode())) for d in DOCS}
    assert {(r["doc_id"], r["payload_sha256"], r["n_bytes"]) for r in got} == model
    by_text = collections.defaultdict(set)
    for r in got:
        payload = media.padded(next((d[1] or "").encode() for d in DOCS if d[0] == r["doc_id"]))
        assert r["tail_crc32"] == zlib.crc32(payload[-32:]) and r["payload_bytes"] % 576 == 0 and r["media_bytes"] == len(media.to_wav(payload))
        by_text[r["payload_sha256"]].add((r["feature"], r["media_sha256"], tuple(r["codes"]), tuple(r["times"])))
    assert all(len(v) == 1 for v in by_text.values()) and len({x for v in by_text.values() for x in v}) == len(by_text)


def test_media_peaks_of_tones():
    t = np.arange(576 * 4)
    tone = lambda k: np.round(127 + 50 * np.sin(2 * np.pi * k * t / 576)).astype(np.uint8).tobytes()
    assert (media.peaks(tone(30))[:, 0] == 30).all() and (media.peaks(tone(200))[:, 0] == 200).all()


@pytest.mark.parametrize("n", [0, 100, 576, 577, 3000])
def test_media_pairs_by_direct_transform(n):
    """Peaks of each frame by the sums that define the transform, and pairs by going over them one by one."""
    samples = media.padded(bytes(random.Random(n).choices(range(256), k=n)))
    x = np.frombuffer(samples, np.uint8) / 128 - 1
    table_ = np.exp(-2j * np.pi * np.outer(np.arange(1, media.FRAME // 2 + 1), np.arange(media.FRAME)) / media.FRAME)
    found = []
    for at in range(0, len(x) - media.FRAME + 1, media.HOP):
        power = np.abs(table_ @ (x[at : at + media.FRAME] * np.hanning(media.FRAME))) ** 2
        width = len(power) // media.BANDS
        best = sorted(((max(power[b * width : (b + 1) * width]), b * width + int(np.argmax(power[b * width : (b + 1) * width])) + 1) for b in range(media.BANDS)), reverse=True)[: media.PEAKS]
        found.append([f for _, f in best])
    pairs = [(t, p[0] << 16 | p[1] << 4) for t, p in enumerate(found)]
    pairs += [(t, a << 16 | b << 4 | gap) for t, p in enumerate(found) for gap in range(1, media.AHEAD + 1) if t + gap < len(found) for a in p for b in found[t + gap]]
    times, codes = media.fingerprint(samples)
    assert list(zip(times.tolist(), codes.tolist())) == sorted(pairs)


# --- licences


def test_licences(docs, empty):
    import re

    weights = licences.idf(docs)
    got = {(r["doc_id"], i): r for i, r in enumerate(rows(licences.scan(docs, weights)))}
    assert len(got) == len(DOCS) and licences.scan(empty, licences.idf(empty)).count() == 0
    for (doc_id, _), r in got.items():
        text = next(d[1] for d in DOCS if d[0] == doc_id) or ""
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        places = [(i, label) for label, p in licences.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == (min((p for p, _ in places), default=None), max((p for p, _ in places), default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and set(r["base_labels"].split(",")) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
    labels = {r["doc_id"]: r["labels"] for r in got.values()}
    assert labels[15] == "mit,mit-notice" and labels[16] == "apache,gpl,gpl-3.0"


def _labels(texts, weights=None):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    found = next(licences._scan(iter([batch]), weights or {w: 1.0 for w in licences._words()}))
    return [set(filter(None, x.split(","))) for x in found.column("labels").to_pylist()]


def _model_labels(text):
    """Every template is tried at every place."""
    import re

    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    out = {label for label, p in licences.PHRASES if any(words[i : i + len(p.split())] == p.split() for i in range(len(words)))}
    for label, notice, key, share in licences.TEMPLATES:
        own, phrase = notice.split(), key.split()
        at = next(k for k in range(len(own)) if own[k : k + len(phrase)] == phrase)
        shift = licences.SHIFT if len(own) > len(phrase) + 4 else 0
        for i in range(len(words)):
            if words[i : i + len(phrase)] == phrase:
                found = sum(own[k] in words[max(0, i - at + k - shift) : max(0, i - at + k + shift + 1)] for k in range(len(own)))
                if found / len(own) >= share:
                    out.add(label)
    return out


@pytest.mark.parametrize("lookups", [0, 2, 16])
def test_licences_against_every_place(monkeypatch, lookups):
    monkeypatch.setattr(licences, "LOOKUPS", lookups)
    rng, texts = random.Random(4), []
    for _, notice, _, _ in licences.TEMPLATES * 3:
        words = notice.split()
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(2)] = rng.choices(["Acme", "2.0", "license", "the", "of", "é"], k=rng.randrange(3))
        texts.append("x " * rng.randrange(3) + " ".join(words).title() + rng.choice(["", ".", " and the MIT License", " cc-by cc by"]))
    weights = {w: rng.random() for w in licences._words()}
    assert _labels(texts, weights) == [_model_labels(t) for t in texts]


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("BSD 3-Clause License\n\nCopyright (c) 2024, A", "bsd-3-clause"), ("ISC License", "isc-title"), ("// SPDX-License-Identifier: Apache-2.0", "spdx:apache-2-0"), ("The MIT License (MIT)", "mit-title"), ("Apache License Version 2.0", "apache-2.0"),
        ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE', "mit-disclaimer"),
        ("Neither the name of Acme Widgets, Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "bsd-3-clause"),
    ],
)
def test_licence_labels(text, label):
    assert label in _labels([text])[0]


@pytest.mark.parametrize("text", ["the software is good", "mit", "permission is hereby granted free of charge", "a license of the apache kind", "gnu public"])
def test_no_licence_labels(text):
    assert _labels([text]) == [set()]


@pytest.mark.parametrize("template", [t for t in licences.TEMPLATES if t[3] < 1])
def test_licence_without_its_rarest_words(template):
    """Whatever words the corpus makes rare, a notice with its key phrase and enough of its other words is found."""
    label, notice, key, share = template
    words = notice.split()
    at = next(k for k in range(len(words)) if words[k : k + len(key.split())] == key.split())
    for lacking in set(range(len(words))) - set(range(at, at + len(key.split()))):
        if (len(words) - 1) / len(words) < share:
            continue
        text = " ".join("zzz" if k == lacking else w for k, w in enumerate(words))
        assert label in _labels([text], {w: 1.0 for w in licences._words()} | {words[lacking]: 10.0})[0], (text, lacking)


# --- packing


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    got = rows(packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")))
    assert len({r["sequence_id"] for r in got}) == len(got) and packing.pack_documents(empty, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    whole = collections.Counter()
    for d in DOCS:
        ids = [*t.encode(d[1] or "", add_special_tokens=False).ids, 1]
        for start, n in packing.pieces(len(ids)):
            part = ids[start : start + n]
            whole[(d[0], start, n, tuple(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids))] += 1
    assert collections.Counter((r["doc_id"], r["start"], r["length"], tuple(r["ids"]), r["ids_crc32"], r["doc_tokens"]) for r in got) == whole
    assert all(r["offset"] == 0 and r["length"] <= 2048 and r["length"] & (r["length"] - 1) == 0 and 1 << r["bucket"] == r["length"] for r in got)


def test_packing_by_other_vocabularies_and_buckets(spark, tmp_path):
    """A vocabulary that keeps white space takes the whole way; buckets become folders."""
    from tokenizers import Tokenizer

    other = public_tokenizers.path("byte_bpe_50k.json")
    assert packing._by_words(public_tokenizers.path("word_bpe_49k.json")) and not packing._by_words(other)
    t = Tokenizer.from_file(other)
    texts = ["Two  words\n and more", "", "Ünïcode text! " * 30]
    packed = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), other)
    got = collections.defaultdict(list)
    for r in sorted(rows(packed), key=lambda r: (r["doc_id"], r["start"])):
        got[r["doc_id"]] += r["ids"]
    assert dict(got) == {i: [*t.encode(x, add_special_tokens=False).ids, 1] for i, x in enumerate(texts)}
    packing.write_buckets(packed, f"{tmp_path}/out")
    assert {r.length for r in spark.read.parquet(f"{tmp_path}/out/bucket=0").collect()} == {1}


@pytest.mark.parametrize("n", [1, 2, 3, 2047, 2048, 2049, 10_000])
def test_pieces(n):
    found = list(packing.pieces(n))
    assert sum(x for _, x in found) == n and all(a + b == c for (a, b), (c, _) in zip(found, found[1:]))


# --- SimHash


def model_print(text, width=4):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    k = min(width, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def model_components(prints):
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= 4:
            parent[root(a)] = root(b)
    return {p: root(p) for p in prints}


def test_simhash(docs, empty):
    got = rows(simhash.components(docs))
    prints = {d[0]: model_print(d[1]) for d in DOCS}
    roots = model_components(set(prints.values()))
    for r in got:
        assert r["print"] % (1 << 64) == prints[r["doc_id"]]
        near = [d for d, p in prints.items() if d is not None and roots[p] == roots[prints[r["doc_id"]]]]
        assert r["component_id"] == min(near, default=None)
    assert len(got) == len(DOCS) and simhash.components(empty).count() == 0
    kept = rows(simhash.keep_first(docs))
    assert list(kept[0]) == docs.columns
    assert {r["doc_id"] for r in kept if r["doc_id"] is not None} == {r["component_id"] for r in got if r["doc_id"] is not None}


@pytest.mark.parametrize("shard", [3, 4096])
def test_simhash_links(spark, shard):
    rng = random.Random(5)
    values = set()
    for base in (rng.getrandbits(64) for _ in range(12)):
        for _ in range(18):
            x = base
            for _ in range(rng.randint(0, 6)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = simhash.connected(simhash.links(spark.createDataFrame([(v,) for v in signed], "print long"), shard=shard))
    got = {r.node % (1 << 64): r.root for r in found.collect()}
    roots = model_components(values)
    groups = collections.defaultdict(set)
    for v, r in roots.items():
        groups[r].add(v)
    own = collections.defaultdict(set)
    for v in values:
        own[got.get(v, v - (1 << 64) if v >> 63 else v)].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, own.values()))


def test_tree_kinds_agree():
    rng = np.random.default_rng(2)
    values = np.unique(rng.integers(0, 1 << 20, 60, dtype=np.uint64))
    near = {(min(a, b), max(a, b)) for a, b in itertools.combinations(values.tolist(), 2) if (a ^ b).bit_count() <= 4}
    found = {(min(int(values[n]), int(values[q])), max(int(values[n]), int(values[q]))) for n, qs in simhash.BKTree(values).within(values, 4) for q in qs if values[n] != values[q]}
    assert found == near
    a, b = simhash.small_edges(values.astype(np.int64).tolist()), simhash.shard_edges(values, values)
    assert len(a) == len(b)


# --- classifier


def test_classifier_held_out(spark):
    found = classifier_accuracy(spark, "/root/testdata/sf0.01")
    assert found > 0.9


def classifier_accuracy(spark, sf_dir):
    scored = queries.queries()["op7_classifier"](spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    both = scored.join(labels, "doc_id").filter("held_out").select("score", "quality").collect()
    good, bad = [r.score for r in both if r.quality == 1], [r.score for r in both if r.quality == 0]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def test_classifier_accuracy_figures(spark):
    scored = queries.queries()["op7_classifier"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out")
    assert scored.filter("predicted = quality").count() / scored.count() > 0.9


def test_classifier_rows_are_bounded(spark, monkeypatch):
    """One id of very many rows is one row to learn from; a column of the machine's name stays."""
    many = spark.createDataFrame([(1, f"text {i}", 0.125) for i in range(300)] + [(i, f"words {i}", 0.125) for i in range(2, 30)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(classifier, "fit", lambda rows: seen.append(len(rows)) or classifier.Machine())
    machine = classifier.train(many, labels, sample=5)
    assert seen[0] <= 5
    machine.constant = 1.0
    assert {r["score"] for r in rows(classifier.keep_good(many, machine))} == {0.125}


def test_classifier_reads_whole_words():
    data = np.frombuffer(("a" * 30 + "b" + "a" * 30 + " " + "a" * 30 + "c" + "a" * 30).encode(), np.uint8)
    first, second = classifier._hash(data, np.array([0, 62]), np.array([61, 123]))
    assert first != second and classifier._hash(data, np.array([0, 62]), np.array([30, 92]))[0] == classifier._hash(data, np.array([0, 62]), np.array([30, 92]))[1]


def test_classifier_cases(docs, empty, spark):
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    machine = classifier.train(docs, no_labels)
    got = rows(classifier.score(docs, machine))
    assert {r["score"] for r in got} == {1.0} and len(got) == len(DOCS)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    machine = classifier.train(docs, labels)
    got = rows(classifier.score(docs, machine))
    assert all(0 <= r["score"] <= 1 for r in got) and len({r["score"] for r in got if r["doc_id"] in (4, 5)}) == 1
    assert classifier.score(empty, machine).count() == 0 and classifier.keep_good(docs, machine).columns == docs.columns
    assert not rows(docs.select(classifier.held_out(F.col("doc_id")).alias("h")).filter("h is null"))


def test_sum_of_squares_identity():
    m = classifier.Machine()
    rng = np.random.default_rng(1)
    feature, value = np.array([3, 9, 40]), np.array([0.5, 0.2, 0.7], np.float32)
    m.weights[feature] = rng.normal(size=3)
    pairs = sum(m.factors[a] @ m.factors[b] * value[i] * value[j] for (i, a), (j, b) in itertools.combinations(enumerate(feature), 2))
    raw, _ = m.raw(np.zeros(3, int), feature, value, 1)
    assert raw[0] == pytest.approx(float(m.weights[feature] @ value + pairs), rel=1e-4)


# --- extraction

STORY = ("this is the story of a day and of the night " * 8).strip()
RUSSIAN = ("Это длинная статья о погоде и о природе. " * 10).strip()


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("<nav><a href=x>Home</a></nav>", ""), ("<article><h1>A &amp; B</h1><p>wo<b>rd</b>\n one<br>two<p>Last.</article><footer>&copy; x</footer>", "A & B word one two Last."),
        ("<article><p>Body text.<div class='ad-box'>Buy now</div><p>More.<section id=comments><p>Nice post!</section></article>", "Body text. More."),
        ("<body><div class=sidebar><p>" + "the links of the day and more of it " * 9 + "</div><div><p>" + STORY + "</p></div></body>", STORY),
        ("<body><div><p>" + STORY + "</p><p>Short end.</p></div></body>", STORY), ("<p>Short start.<p>" + STORY + "<p>Short middle.<p>" + STORY + "<ul><li><a href=x>More</a></ul>", f"{STORY} Short middle. {STORY}"),
        ("<article><script>var a='</p>';</script><p a='>'>Text<!-- no --> here</article>", "Text here"), ("<article><header><h1>Title</h1></header><form><p>Sign up</form><p>x &#233; &nbsp; y</article>", "Title x é y"), ("<article><p>open", "open"),
        (f'<div id="content"><p>{RUSSIAN}</p><p>{RUSSIAN}</p></div>', f"{RUSSIAN} {RUSSIAN}"), (f'<div class="post-body comments-open"><p>{STORY}</p></div>', STORY), (f'<div class="content has-sidebar"><article><p>{STORY}</p></article></div>', STORY),
        (f"<form><nav><a href=x>x</a></nav><div><p>{STORY}</p></div></form>", STORY), (f"<form><article><p>{STORY}</p></article></form>", STORY), (f'<div class="sidebar-layout"><article><p>{STORY}</p></article></div>', STORY),
        (f'<article><p>{STORY}</p></article><section id="comments"><article class="comment"><p>Great! {STORY}</p></article></section>', STORY), (f"<article><p title=don't>{STORY}<p>1 < 2 and 3</article>", f"{STORY} 1 < 2 and 3"), ("<article><p title='a>b'>x</p><p", "x <p"),
    ],
)
def test_extraction(page, text):
    assert extraction.main_text(page) == text


@pytest.mark.parametrize("part", ["<a ", '<a x="', "<a x='", "<div></ul>", "<!--", "<title>", "<script", "a<", "&#", "<p>b"])
def test_extraction_of_a_million_bytes(part):
    began = time.process_time()
    extraction.main_text("<article>" + part * (1_000_000 // len(part)))
    assert time.process_time() - began < 8


class _Article(HTMLParser):
    """What stands in <article> by the standard library's parser, block by block."""

    def __init__(self):
        super().__init__()
        self.depth, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag in ("p", "h1", "article", "br"):
            self.blocks.append("") if tag != "br" else self.handle_data(" ")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        if tag in ("p", "h1", "article"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.depth:
            self.blocks[-1] += data


def test_extraction_against_another_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in rows(extraction.extract(pages))}
    for page in rows(pages):
        parser = _Article()
        parser.feed(page["html"] or "")
        parser.close()
        text = " ".join(x for x in (" ".join(b.split()) for b in parser.blocks) if x)
        assert (got[page["page_id"]]["text"], got[page["page_id"]]["n_chars"]) == (text, len(text))


def test_extraction_table(spark):
    got = rows(extraction.extract(spark.createDataFrame([(1, "u", None, 5), (None, None, "<article><p>é</article>", 6)], "page_id long, url string, html string, text int")))
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got) == [(0, "é", 1), (1, "", 0)]


# --- rules


def test_rules(docs, empty):
    import re

    got = rows(rules.apply_policy(rules.ledger(docs)))
    assert len(got) == len(DOCS) and rules.ledger(empty).count() == 0
    for r in got:
        text = next(d[1] for d in DOCS if d[0] == r["doc_id"]) or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        many = collections.Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(words) < 10 or 100 * len(covered) > 20 * len(words)) and not (r["base_failed"] and r["kept"])
    assert rules.keep_good(docs).columns == docs.columns and rules.keep_good(docs).count() == sum(r["kept"] for r in got)
    ablated = {r["rule"]: r for r in rows(rules.ablations(rules.ledger(docs)))}
    assert ablated["min_words"]["n_failed"] == sum(bool(r["failed"] & 1) for r in got)
    assert [r["n_failed"] for r in rows(rules.ablations(rules.ledger(empty)))] in ([], [None] * len(rules.RULES))


# --- suffix arrays


@pytest.mark.parametrize("by_bucket", [256, 0])
def test_suffix_array(monkeypatch, by_bucket):
    rng = random.Random(3)
    monkeypatch.setattr(suffixes, "BYTES", by_bucket)
    for _ in range(300):
        n, k = rng.randint(1, 80), rng.choice([1, 2, 3, 200])
        t = np.array([rng.randint(1, k) for _ in range(n)] * rng.choice([1, 1, 2]) + [0], np.int64)
        assert suffixes.suffix_array(t, 256).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
    t = np.array([rng.randint(1, 5000) for _ in range(2000)] * 2 + [0])  # more letters than bytes
    data = t.astype(">u4").tobytes()
    assert suffixes.suffix_array(t, 5001).tolist() == sorted(range(len(t)), key=lambda i: data[4 * i :])


def model_removed(docs, length):
    first, flags = {}, {}
    for doc_id, data in docs:
        for i in range(len(data) - length + 1):
            key = data[i : i + length]
            first[key] = min(first.get(key, (doc_id, i)), (doc_id, i))
    for doc_id, data in docs:
        own = flags.setdefault(doc_id, np.zeros(len(data), bool))
        for i in range(len(data) - length + 1):
            if first[data[i : i + length]] != (doc_id, i):
                own[i : i + length] = True
    return flags


@pytest.mark.parametrize(("piece", "hot"), [(1 << 20, 20_000), (700, 1), (1 << 20, 2)])
def test_repeats(docs, empty, spark, monkeypatch, piece, hot):
    monkeypatch.setattr(suffixes, "PIECE_BYTES", piece)
    monkeypatch.setattr(suffixes, "HOT", hot)
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    few = [(d[0], d[1]) for d in DOCS if d[0] is not None][:-1]
    cut = [(i, (t or "")[:9000]) for i, t in few] + [(100, "ab" * 400), (101, LONG[5000:8000]), (102, "é" * 350)]
    cut += [(200 + i, noise(rng.randint(0, 90)) + PASSAGE[rng.randint(0, 80) : rng.randint(150, 300)] + noise(rng.randint(0, 90))) for i in range(30)]
    other, third = noise(400), noise(400)
    # rows that share an id or have none, each of its own text: nothing of them is lost but what stands earlier
    twins = [(1000, LONG[:400]), (1000, other), (None, LONG[:400]), (None, third), (None, third[:200] + noise(200)), (None, None)]
    table = spark.createDataFrame([*cut, (103, None), *twins], "doc_id long, text string").withColumn("key_spans", F.lit(1))
    kept = suffixes.map_arrow(suffixes._with_spans(table.select("doc_id", "text")), lambda b: suffixes._kept(b, -1), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    got = collections.Counter(tuple(r.values()) for r in rows(kept))
    order = lambda d: (d[0] if d[0] is not None else 1 << 62, xxhash.xxh64_intdigest((d[1] or "").encode(), 42) - ((1 << 64) if xxhash.xxh64_intdigest((d[1] or "").encode(), 42) >> 63 else 0) if d in twins else 0)
    model = sorted([*cut, (103, None), *twins], key=order)
    flags = model_removed([(k, (t or "").encode()) for k, (_, t) in enumerate(model)], suffixes.LENGTH)
    want = collections.Counter()
    for k, (i, t) in enumerate(model):
        data, gone = (t or "").encode(), flags[k]
        left = bytes(b for b, g in zip(data, gone) if not g)
        spans = int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        want[(i, len(data), int(gone.sum()), spans, hashlib.sha256(left).hexdigest())] += 1
    assert got == want
    out = suffixes.without_repeats(table)
    assert out.columns == table.columns and out.count() == len(model)
    out = suffixes.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(DOCS) and suffixes.without_repeats(empty).count() == 0


def test_repeats_of_equal_rows_and_no_utf8(spark):
    bad = spark.sql("SELECT id AS doc_id, CAST(concat(CAST(repeat('abc', 60) AS BINARY), x'61ff62fe') AS STRING) AS text FROM VALUES (1L), (1L), (2L) t(id)")
    out = sorted((r["doc_id"], r["text"]) for r in rows(suffixes.without_repeats(bad)))
    assert out[0] == out[1] and out[0][1].startswith("abc") and out[2] == (2, "")


# --- pipeline


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts, now = [docs.count()], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.stash(stage(spark, now, SF), name)
        assert now.columns == docs.columns
        counts.append(now.count())
    assert counts[0] > counts[1] >= counts[2] > counts[3] == counts[4] > 0.5 * counts[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert packed.select("doc_id").distinct().count() == now.select("doc_id").distinct().count()


def _shingles(text, width=5):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def _copies():
    """Texts with copies at all similarities from 0.5 to 1: by words changed here and there, by longer ends, and in chains."""
    rng = random.Random(5)
    texts = [None, "", " ", "one two", "One  two", "one two three"]
    for n in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([12, 60, 200]))]
        texts.append(" ".join(words))
        for _ in range(3):
            other = list(words)
            for at in rng.sample(range(len(words)), rng.randrange(1, 2 + len(words) // 40)):
                other[at] = f"x{rng.randrange(3000)}"
            texts.append(" ".join(other + [f"y{rng.randrange(3000)}" for _ in range(rng.randrange(1 + len(words) // 8))]))
            words = other if n % 2 else words
    return texts


@pytest.mark.parametrize("shard", [512, 3])
def test_near_copies_by_jaccard(spark, empty, shard):
    texts = _copies()
    sets = [_shingles(t) for t in texts]
    of = list(range(len(texts)))
    bands = collections.Counter()
    for a, b in itertools.combinations(range(len(texts)), 2):
        s = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        bands[int(s * 20)] += 1
        if s >= 0.8:
            low, high = sorted((of[a], of[b]))
            of = [low if x == high else x for x in of]
    assert all(bands[k] > 3 for k in range(12, 19)) and bands[19]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in rows(shingles.components(df, shard=shard))}
    assert got == dict(enumerate(of)) and shingles.components(empty).count() == 0
    if shard == 512:
        corpus_pipeline = pytest.importorskip("corpus_pipeline")
        assert sorted(r["doc_id"] for r in rows(dict(corpus_pipeline.STAGES)["near_copies"](spark, df, SF))) == sorted(set(of))


def test_near_copies_ids(docs):
    got = rows(shingles.components(docs))
    assert len(got) == len(DOCS)
    assert {r["component_id"] for r in got if r["doc_id"] in (0, 1, 2, 3)} == {0} and {r["component_id"] for r in got if r["doc_id"] in (8, 9)} == {8}
    kept = rows(shingles.keep_first(docs))
    assert sum(r["doc_id"] is None for r in kept) == 1 and {0, 4, 8} <= {r["doc_id"] for r in kept} and not {1, 2, 3, 9} & {r["doc_id"] for r in kept}


def test_near_copies_of_long_texts(spark):
    rng = random.Random(9)
    base, n = [f"w{rng.randrange(20000)}" for _ in range(9000)], 24
    texts = []
    for k in range(n):  # half of them link, at shares about the bound and above, half share keys and don't
        own = list(base)
        for at in rng.sample(range(len(own)), 30 * k if k < n // 2 else 220):
            own[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    sets = [_shingles(t) for t in texts]
    of = list(range(n))
    for a, b in itertools.combinations(range(n), 2):
        if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
            low, high = sorted((of[a], of[b]))
            of = [low if x == high else x for x in of]
    assert 5 < len(set(of)) < n - 5 and min(map(len, sets)) > 2 * shingles.SKETCH
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    store = spark.sparkContext._jsc.sc().statusStore()
    moved = lambda: sum(store.executorList(True).apply(k).totalShuffleWrite() for k in range(store.executorList(True).size()))
    before = moved()
    assert {r["doc_id"]: r["component_id"] for r in rows(shingles.components(df, shard=5))} == dict(enumerate(of))
    assert moved() - before < 12 * 8 * sum(map(len, sets))
    few = [np.sort(np.array([hash(x) for x in s], np.int64).view(np.uint64)) for s in sets]
    for a, b in itertools.combinations(range(n), 2):
        verdict = shingles.judged(few[a][: shingles.SKETCH], few[b][: shingles.SKETCH], len(few[a]), len(few[b]), 0.8)
        assert verdict == shingles.OPEN or (verdict == shingles.LIKELY) == shingles.similar(few[a], few[b], 0.8)


def test_near_copies_by_fingerprints(spark):
    texts = [t for t in _copies() if t and len(t.split()) > 50]
    sets = [shingles.shingle_set(t.encode()) for t in texts]
    bits = [shingles.fingerprint(s) for s in sets]
    plain = [sum((sum(int(h) >> k & 1 for h in s) * 2 > len(s)) << k for k in range(64)) for s in sets]
    assert [int.from_bytes((b & (1 << 64) - 1).to_bytes(8, "big"), "little") for b in bits] == plain
    near, linked = list(range(len(sets))), list(range(len(sets)))
    for a, b in itertools.combinations(range(len(sets)), 2):
        if ((bits[a] ^ bits[b]) & (1 << 64) - 1).bit_count() <= shingles.RADIUS:
            near = [min(near[a], near[b]) if x in (near[a], near[b]) else x for x in near]
    for a, b in itertools.combinations(range(len(sets)), 2):
        if near[a] == near[b] and shingles.similar(sets[a], sets[b], 0.8):
            linked = [min(linked[a], linked[b]) if x in (linked[a], linked[b]) else x for x in linked]
    assert len({x for k, x in enumerate(linked) if x != k}) > 3

    # without min-hash keys, links come from fingerprints alone
    firsts = spark.createDataFrame([(i, b, []) for i, b in enumerate(bits)], "print long, bits long, keys array<long>")
    held = spark.createDataFrame([(i, len(s), s[: shingles.SKETCH].tobytes(), s[shingles.SKETCH :].tobytes()) for i, s in enumerate(sets)], "print long, size long, few binary, rest binary")
    got = {r["node"]: r["root"] for r in rows(shingles.links(firsts, lambda prints: held.join(prints, "print"), 0.8, 512))}
    assert [got.get(i, i) for i in range(len(sets))] == linked
