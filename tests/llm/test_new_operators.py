"""Vector codes, WARC archives and the name join against brute-force versions, with nulls, blanks, ties, repeats and long texts."""

import base64
import gzip
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusforge.llm import namejoin, scratch, vectorcode, warc

# op 11


def brute_codes(rows, parts, entries, rounds, scale):
    kept = [(k, label, [math.floor(scale * x) for x in v]) for k, label, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][2]) // parts
    cut = [[x[p * width : (p + 1) * width] for p in range(parts)] for _, _, x in kept]
    ids = sorted({k for k, _, _ in kept}, key=lambda k: (k is None, k))[:entries]
    seeds = [min(x for k, _, x in kept if k == i) for i in ids]
    books = [[x[p * width : (p + 1) * width] for x in seeds] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min(range(len(books[p])), key=lambda e: (far(c[p], books[p][e]), e)) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        chosen = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, a in zip(cut, chosen) if a[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    chosen = assign()
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    errors = [sum(far(c[p], books[p][a[p]]) for p in range(parts)) for c, a in zip(cut, chosen)]
    total = defaultdict(int)
    for (_, label, _), e in zip(kept, errors):
        total[label] += e
    return Counter((k, "".join(f"{e:02x}" for e in a), err, total[label], digest) for (k, label, _), a, err in zip(kept, chosen, errors))


VECTORS = "vec_id long, embedding array<float>, label int, key string, x int, code int, moved int"


def vector_table(spark, rows):
    return spark.createDataFrame([(k, v, label, "k", 1, 2, 3) for k, label, v in rows], VECTORS).repartition(3)


def vector_rows(n, dim, seed):
    rng = random.Random(seed)
    rows = [(i * 3 % n, rng.choice([0, 0, 0, 1, None]), [rng.choice([-1.5, -0.25, 0.1, 0.1004, 2.0]) * rng.randrange(3) for _ in range(dim)]) for i in range(n)]
    rows += [rows[4], rows[4], (None, 2, rows[5][2]), (None, 2, rows[6][2])]  # repeats, null keys
    return rows + [(1000, 0, None), (1001, 0, [0.0] * (dim - 1) + [None]), (1002, 0, [float("nan")] * dim), (1003, 1, [float("inf")] + [0.0] * (dim - 1)), (1004, 1, [])]


@pytest.mark.parametrize("n,dim,parts,entries,rounds", [(120, 8, 4, 16, 4), (60, 6, 2, 256, 3), (40, 4, 4, 1, 2), (80, 8, 4, 16, 0)])
def test_vector_codes_against_brute_force(spark, n, dim, parts, entries, rounds):
    rows = vector_rows(n, dim, n)
    out = vectorcode.codes(vector_table(spark, rows), parts=parts, entries=entries, rounds=rounds, scale=1024)
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(map(tuple, out.collect())) == brute_codes(rows, parts, entries, rounds, 1024)


def test_vector_codes_of_large_components(spark):
    """Beyond exact floating point; and beyond a long, where components are held."""
    rng = random.Random(5)
    rows = [(i, 0, [float(rng.randrange(-100_000, 100_000)) for _ in range(8)]) for i in range(50)]
    assert Counter(map(tuple, vectorcode.codes(vector_table(spark, rows), entries=8, rounds=3).collect())) == brute_codes(rows, 4, 8, 3, 1024)
    held = vectorcode.codes(vector_table(spark, [(i, 0, [3e38 * (-1) ** i] * 8) for i in range(6)]), entries=2, rounds=2).collect()
    assert len(held) == 6 and {r.error for r in held} == {0}


def test_vector_codes_none_and_other_lengths(spark):
    table = vector_table(spark, [])
    assert vectorcode.codes(table).collect() == [] and vectorcode.codes(vector_table(spark, [(1, 1, None)])).count() == 0
    mixed = vectorcode.codes(vector_table(spark, [(1, 1, [1.0, 2.0, 3.0, 4.0]), (2, 1, [1.0] * 8), (3, 1, [1.0] * 3), (0, 1, [1.0] * 5)]))
    assert [r.vec_id for r in mixed.collect()] == [1]


def test_only_changed_assignments_are_summed_again(spark):
    rows = vector_table(spark, vector_rows(100, 8, 3))
    fitted, state = vectorcode.fit(rows, entries=8, rounds=6)
    moved = state.where("moved").count()
    assert moved < state.count() / 2
    assert fitted.books.shape == (4, 8, 2)
    coded = vectorcode.encode(rows, fitted).withColumn("near", vectorcode.decode(F.col("code"), fitted)).collect()
    best = {tuple(r.near) for r in coded}
    assert best and all(len(v) == 8 for v in best)
    scratch.discard(state)


# op 12

PAGES = "page_id long, url string, html string, key string, name string, same string, file string, payload string"


def page_rows():
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(i, f"http://h{i % 3}.example.com/p/{i}?q=ü {i}", f"<p>text {i}</p>") for i in range(30)]
    rows += [(100 + i, "http://hot.example.com/", "<p>copy</p>") for i in range(40)]  # one url, one payload
    rows += [(200, None, "<p>text 3</p>"), (201, "", None), (202, "no scheme at all", ""), (203, "http://x/" + "y" * 3000, long), (204, "http://user@UPPER.example.com:80/a\r\nb", long)]
    rows += [(205, "http://a.example.com/", "warc\r\n\r\nWARC/1.1\r\n\r\n"), (5, "http://h2.example.com/p/5?q=ü 5", "<p>text 5</p>"), (None, "http://none.example.com/", "<p>copy</p>"), (None, "http://none.example.com/", "only here 😀")]
    return rows


def page_table(spark, rows):
    return spark.createDataFrame([(*r, "k", "n", "s", "f", "p") for r in rows], PAGES).repartition(4)


def brute_pages(rows, min_bytes=0):
    most = {}
    for k, _, html in rows:
        body = (html or "").encode()
        if len(body) >= min_bytes and k is not None:
            most[body] = max(most.get(body, k), k)
    out = Counter()
    for k, _, html in rows:
        body = (html or "").encode()
        top = most.get(body)
        other = top is not None and top != k and len(body) >= min_bytes
        out[k, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if other else "response", top if other else None] += 1
    return out


@pytest.mark.parametrize("min_bytes", [0, 12])
def test_warc_round_trip(spark, min_bytes):
    rows = page_rows()
    out = warc.round_trip(page_table(spark, rows), min_bytes=min_bytes, file_bytes=2000)
    assert out.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert Counter(map(tuple, out.collect())) == brute_pages(rows, min_bytes)


def test_warc_without_pages(spark):
    assert warc.round_trip(page_table(spark, [])).collect() == []


def test_warc_files_and_lookups(spark, monkeypatch):
    """Files are whole gzip members with right lengths; one url is found without the others; small blocks and files."""
    for name, value in (("LINES", 4), ("FILE_LINES", 20)):
        monkeypatch.setattr(warc, name, value)
    folder = scratch.folder(spark)
    rows = page_rows()
    warc.write(page_table(spark, rows), folder)
    local = Path(folder.removeprefix("file://"))
    seen = 0
    for file in local.glob("data/*.warc.gz"):
        raw = gzip.decompress(file.read_bytes())
        while raw:
            head, _, rest = raw.partition(b"\r\n\r\n")
            size = int(head.rpartition(b"Content-Length: ")[2])
            assert rest[size : size + 4] == b"\r\n\r\n"
            seen += b"warcinfo" not in head
            raw = rest[size + 4 :]
    assert seen == len(rows)
    blocks = [b for file in local.glob("index/*.cdx.gz") for b in gzip.decompress(file.read_bytes()).split(b"\n")[:-1]]
    assert len(blocks) == len(rows) and len(list(local.glob("index/*.dir"))) > 1
    keys = spark.createDataFrame([("http://hot.example.com/",), ("http://user@UPPER.example.com:80/a\r\nb",), ("http://nowhere.example.com/",), (None,)], "url string").select(warc.url_key(F.col("url")))
    found = warc.resolved(warc.lookup(spark, folder, keys), folder, payloads=True).collect()
    assert Counter(r.record_type for r in found) == {"revisit": 39, "response": 2}
    assert {bytes(r.payload).decode() for r in found} == {"<p>copy</p>", rows[-5][2]}
    assert {r.refers_page for r in found} == {None, "139"}
    scratch.drop_folder(spark, folder)


def test_url_keys(spark):
    urls = ["https://Blog.Example.com/a?b#c", "http://u@h.org:80/", "urn:page:1", "h.org/x", ""]
    keys = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "url string").select(warc.url_key(F.col("url"))).collect()]
    assert keys == ["com,example,blog)/a?b#c", "org,h):80/", "urn:page:1", "h.org/x", ""]


# op 13


def one_edit(s, letters):
    out = {s}
    for i in range(len(s) + 1):
        out |= {s[:i] + c + s[i:] for c in letters}
        if i < len(s):
            out |= {s[:i] + s[i + 1 :]} | {s[:i] + c + s[i + 1 :] for c in letters}
        if i + 1 < len(s):
            out.add(s[:i] + s[i + 1] + s[i] + s[i + 2 :])
    return out


@pytest.mark.parametrize("start", ["", "a", "abc", "abcab", "aabbc"])
def test_distances_against_all_edits(start):
    least, layer = {start: 0}, {start}
    for k in (1, 2, 3):
        layer = {t for s in layer for t in one_edit(s, "abc")} - least.keys()
        least |= dict.fromkeys(layer, k)
    names = list(least)
    for most in (0, 1, 2, 3):
        assert namejoin.distances([start] * len(names), names, most, 2).tolist() == [least[n] if least[n] <= most else -1 for n in names]
    assert namejoin.distances(["x" * 5000 + "ab"], ["x" * 5000 + "ba"], 1, 3).tolist() == [1]
    assert namejoin.distance("ca", "abc") == 2  # the exchanged pair is edited again


def plain(name):
    if name is None:
        return None
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in name if c not in " \t\n\x0b\x0c\r") or None


def swapped(key, name):
    if key is None or name is None:
        return name
    h = zlib.crc32(str(key).encode())
    if h % 2 or len(name) < 2:
        return name
    i = h % (len(name) - 1)
    return name[:i] + name[i + 1] + name[i] + name[i + 2 :]


def brute_matches(left, right, most):
    found = defaultdict(list)
    for v, name in {(v, plain(name)) for v, name in right}:
        for c, other in left:
            a, b = name, plain(other)
            if a and b and abs(len(a) - len(b)) <= most and (d := namejoin.distance(a, b)) <= most:
                found[v, d].append(c)
    return Counter((v, d, len(ids), min((i for i in ids if i is not None), default=None), sum(zlib.crc32(str(i).encode()) for i in ids if i is not None) if any(i is not None for i in ids) else None) for (v, d), ids in found.items())


def name_rows(seed, n):
    rng = random.Random(seed)
    parts = ["an", "jo", "ström", "ber", "él", "vic", "ma", "ö", "x", "lo"]
    names = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 6))) for _ in range(n)]
    names = ["Jo Strömber", *names, *(rng.choice(sorted(one_edit(rng.choice(names), "abö "))) for _ in range(n))]
    rows = [(i, rng.choice([str.upper, str.title, str])(x)) for i, x in enumerate(names)]
    rows += [(n * 5 + i, "JO  strömber") for i in range(50)]  # one name with many rows
    return rows + [rows[3], rows[3], (None, "joströmber"), (None, None), (9001, None), (9002, ""), (9003, " \t\n"), (9004, "a"), (9005, "ab"), (9006, "ba"), (9007, "y" * 400 + "ab"), (9008, "y" * 400 + "ba")]


@pytest.mark.parametrize("most,gram,together", [(1, 2, 3), (1, 3, 1), (2, 2, 2), (0, 3, 2)])
def test_name_join_against_brute_force(spark, most, gram, together):
    left, right = name_rows(1, 150), name_rows(2, 60)
    of = lambda rows, key: spark.createDataFrame([(*r, 1, "f", 2) for r in rows], f"{key} long, name string, n int, form string, distance int").repartition(3)
    found = namejoin.matches(of(left, "client_id"), of(right, "vendor_id"), "client_id", "vendor_id", F.col("name"), F.col("name"), most, gram, together)
    assert Counter(map(tuple, found.select("vendor_id", "distance", "n", "first", "crc").collect())) == brute_matches(left, right, most)


def test_names_are_misspelt_by_rule(spark):
    rows = [*name_rows(3, 40), (None, "ab"), (7, "a"), (8, "😀é"), (10, "")]
    got = spark.createDataFrame(rows, "id long, name string").select("id", "name", namejoin.misspelt(F.col("id"), F.col("name"))).collect()
    assert all(r[2] == swapped(r[0], r[1]) for r in got)


def test_name_join_of_nothing(spark):
    none = spark.createDataFrame([], "id long, name string")
    some = spark.createDataFrame([(1, "abc")], "id long, name string")
    for left, right in ((none, some), (some, none), (none, none)):
        assert namejoin.matches(left, right, "id", "id", F.col("name"), F.col("name")).collect() == []
