"""Archives by round trip and broken bytes, clusters and phrases against brute force."""

import base64
import hashlib
import math
import random
import re
import struct
from collections import Counter

import pytest
import zstandard
from pyspark.sql import functions as F

from casagrid.llm import centroids, collocations, warc
from casagrid.llm.shared import shared_path

# WARC


PAGES = "page_id long, url string, html string, id string, n string, frame string, sha1 string, of string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "u", "v") for r in rows], PAGES)


def odd_pages(many=0):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice(("<p>", "ka", "lo", "é", "\n", "\U0001f600", " ")) for _ in range(n))
    same, skip = text(300), "a" + warc.EMPTY_FRAME + "b"
    rows = [
        (1, "http://a.example/x y\r\nz", same), (5, None, same), (3, "", same), (2, "http://b.example/", None), (9, "http://b.example/", ""), (7, "u", skip),
        (8, "u", skip + skip), (8, "u", skip + skip), (None, "n", same), (None, "n", "alone"), (None, None, None), (11, "long", text(400_000)), (-4, "neg", "alone too"),
    ]
    return rows + [(100 + i, f"http://c.example/{i}", text(rng.randint(0, 3000))) for i in range(many)]


def expected(rows, least):
    found = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        ids = [r[0] for r in rows if (r[2] or "").encode() == payload and r[0] is not None]
        other = max(ids) if ids and len(payload) >= least and page_id != max(ids) else None
        sha1 = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        found.append((page_id, len(payload), sha1, "response" if other is None else "revisit", other))
    return sorted(map(repr, found))


def page_of(record_id):
    return None if record_id is None or record_id.split(":")[2] == "none" else int(record_id.split(":")[2])


@pytest.mark.parametrize(("least", "many"), [(0, 0), (1000, 0), (0, 600)])
def test_archives_come_back(spark, least, many):
    rows = odd_pages(many)
    got = warc.archived(pages(spark, rows), least).collect()
    assert sorted(repr((page_of(r.id), r.payload_bytes, r.payload_digest, r.type, page_of(r.refers_to))) for r in got) == expected(rows, least)


def test_payloads_addresses_and_dictionary(spark):
    rows, path = odd_pages(900), shared_path(spark, "test-warc")
    warc.write_archives(pages(spark, rows), path, least=10**9)
    data = [bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect()]
    assert sum(warc.leading_dictionary(memoryview(d))[0] != b"" for d in data) == len([d for d in data if d]) > 0
    got = warc.read_archives(spark, path).filter("type = 'response'").collect()
    assert Counter(bytes(r.payload) for r in got) == Counter((h or "").encode() for _, _, h in rows)
    assert {r.uri for r in got} >= {"http://a.example/x%20y%0D%0Az", None, "", "neg"}


def test_no_pages(spark):
    assert warc.archived(pages(spark, []).limit(0)).count() == 0


def test_frames_are_found_by_any_decoder():
    press = zstandard.ZstdCompressor(write_checksum=True)
    contents = [b"", b"a" * 300_000, random.Random(1).randbytes(400_000), b"P*M\x18\0\0\0\0"]
    data = b"".join(press.compress(c) + warc.EMPTY_FRAME.encode() for c in contents)
    assert list(warc.frames(memoryview(data))) == contents
    assert zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read() == b"".join(contents)
    stream = zstandard.ZstdCompressor().compressobj()  # a frame that does not tell its length
    assert list(warc.frames(memoryview(stream.compress(b"abc" * 10_000) + stream.flush()))) == [b"abc" * 10_000]


@pytest.mark.parametrize("plain", [True, False])
def test_raw_and_packed_dictionaries(plain):
    rng = random.Random(5)
    samples = [" ".join(rng.choice(("alpha", "beta", "gamma", "delta", str(i))) for _ in range(200)).encode() for i in range(1500)]
    known = warc.trained(samples)
    assert known
    lead = struct.pack("<II", warc.DICTIONARY, len(known)) + known if plain else warc.dictionary_frame(known)
    data = lead + b"".join(warc.compressor(known, 3).compress(s) for s in samples)
    assert list(warc.frames(memoryview(data))) == samples
    with pytest.raises(warc.BadArchive):
        list(warc.frames(memoryview(data[len(lead) :])))


def test_broken_archives_raise():
    payload = b"some text " * 100
    good = warc.response("urn:page:1:x", "u", warc.NO_DATE, payload, warc.digest(payload))
    assert warc.parsed(good)["payload"] == payload
    bad = [
        good[:-1], good + b"x", good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"WARC-Date", b"X-Date"), good.replace(b"some", b"same"),
        good.replace(b"Content-Length: 1", b"Content-Length: 2"), good.replace(b"Content-Length: ", b"Content-Length: -"), good.replace(b"sha1:", b"md5:"), b"",
    ]
    for content in bad:
        with pytest.raises(warc.BadArchive):
            warc.parsed(content)
    frame = zstandard.ZstdCompressor(write_checksum=True).compress(good)
    flipped = bytearray(frame)
    flipped[-1] ^= 1
    for data in (frame[:-5], frame[: len(frame) // 2], frame + b"\0" * 9, frame + b"\1\2", bytes(flipped), warc.dictionary_frame(b"no dictionary") + frame, frame[:9]):
        with pytest.raises(warc.BadArchive):
            list(warc.frames(memoryview(data)))


# Clusters


def brute_clusters(rows, k, rounds, seed, dims, scale):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(x) < 2**52 for x in v)]
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    middle = [list(v) for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(middle))
    for _ in range(rounds if middle else 0):
        of = [near(v)[1] for _, v in kept]
        for c in range(len(middle)):
            own = [v for (_, v), n in zip(kept, of, strict=True) if n == c]
            if own:
                middle[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted(repr((i, near(v)[1], near(v)[0])) for i, v in kept) if middle else [], middle


@pytest.mark.parametrize(("size", "spread"), [(300, 1.0), (5, 1.0), (200, 3e5)])
def test_clusters_against_brute_force(spark, size, spread):
    rng = random.Random(size)
    rows = [(i, [rng.gauss(i % 3, 0.5) * (spread if i % 50 == 7 else 1) for _ in range(6)]) for i in range(size)]
    rows += [(None, [0.5] * 6), (1, None), (2, [1.0] * 5), (3, []), (4, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (6, [math.nan] * 6), (7, [math.inf] * 6), rows[0], rows[0], (8, [1e300] * 6)]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, cluster string, id string").repartition(3)
    got, middle = centroids.clusters(frame, k=4, rounds=3, seed=3, dims=6, scale=1024)
    want, want_middle = brute_clusters(rows, 4, 3, 3, 6, 1024)
    assert middle == want_middle
    assert sorted(repr(tuple(r)) for r in got.collect()) == want


def test_no_clusters(spark):
    frame = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    for rows in (frame, frame.limit(0)):
        got, middle = centroids.clusters(rows, k=2, rounds=2, dims=2)
        assert got.collect() == [] and got.columns == ["vec_id", "cluster", "distance"] and middle == []


# Phrases


def brute_phrases(rows, least, longest, swallow):
    count, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                count.update((lang, tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    found = {}
    kept = {key: a for key, a in count.items() if len(key[1]) > 1 and a >= least}
    for (lang, w), a in kept.items():
        holders = [b for (g, v), b in kept.items() if g == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if any(100 * b >= swallow * a for b in holders):
            continue
        cuts = [(10**6 * a * a // (count[lang, w[:k]] * count[lang, w[k:]]), k, count[lang, w[:k]], count[lang, w[k:]]) for k in range(1, len(w))]
        found[lang, w] = (*min(cuts), a, n[lang])
    return found


@pytest.mark.parametrize(("longest", "least", "swallow", "bits"), [(3, 3, 50, 1 << 26), (4, 2, 70, 1 << 26), (2, 2, 50, 1 << 26), (3, 2, 100, 64)])
def test_phrases_against_brute_force(spark, longest, least, swallow, bits):
    rng = random.Random(longest)
    words = ["the", "The", "ka", "lo", "mi", "É", "é", "x\x1fy", "\x01", "\xa0", "the\x01", "a b"]
    text = lambda n: "".join(rng.choice(words) + rng.choice((" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ! ")) for _ in range(n))
    rows = [(rng.choice(("en", "de", None, "und", "", "x\ny")), text(rng.randint(0, 60))) for _ in range(120)]
    rows += [("en", None), ("en", ""), (None, None), ("en", " ., \n"), ("en", "the " * 3000), ("en", text(20_000)), rows[0], rows[0], ("de", "the")]
    frame = spark.createDataFrame([(i, t, g, "x", "y") for i, (g, t) in enumerate(rows)], "doc_id long, text string, lang string, words string, n string").repartition(3)
    got = collocations.collocations(frame, least, longest, swallow, filter_bits=bits).collect()
    assert {(r.lang, tuple(r.words)): (r.score, r.cut, r.l, r.r, r.a, r.n) for r in got} == brute_phrases(rows, least, longest, swallow)
    assert len(got) == len({(r.lang, r.phrase) for r in got}) > 10


def test_equal_hashes_are_told_apart(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(collocations, "word_hashes", lambda raw, at, *parts: ((h := collocations.word_spans(raw, at, *parts))[1].astype("uint64"), h[2]))
    text = collocations.Text(pa.array(["en", "en"]), pa.array(["ab cd ab", "ef ab"]))
    phrases, count = text.counts(text.places(1), 1)
    assert dict(zip(phrases.to_pylist(), count.tolist(), strict=True)) == {"en\nab": 3, "en\ncd": 1, "en\nef": 1}


def test_products_beyond_64_bits(spark):
    a, l, r = 3_000_000_000_007, 3_500_000_000_001, 3_000_000_000_011
    row = spark.sql(f"select cast(1000000 as decimal(7,0)) * cast({a} as decimal(15,0)) * cast({a} as decimal(15,0)) div (cast({l} as decimal(15,0)) * cast({r} as decimal(15,0))) as s").first()
    assert row.s == 10**6 * a * a // (l * r)


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert collocations.collocations(empty).collect() == []
    assert collocations.collocations(spark.createDataFrame([(1, "a b c", "en")], "doc_id long, text string, lang string")).collect() == []
