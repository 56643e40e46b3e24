"""Revisit records, the audit of filters and the repair of conversations against plain versions, over awkward tables."""

import base64
import gzip
import hashlib
import zlib
from itertools import permutations

import brute
import pytest
from brightloom.llm import conversation, filter_audit, queries, warc
from pyspark.sql import functions as F

TRAP = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc"
PAGES = [
    (1, "http://a.example/ x\ny", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "u", None), (4, "u", ""), (5, "u", TRAP), (6, "u", TRAP + "\r\n\r\nWARC/1.1"), (7, "u", "\r\n\r\nWARC/1.1\r\n"),
    (8, "u", "é漢𝒳" * 30_000), (9, "u", "\r\n\r\nWARC/1.1\r\n" * 300), (9, "u", "\r\n\r\nWARC/1.1\r\n" * 300), (None, "u", "<p>one</p>"), (None, "u", "alone"), (None, "u", "alone"), (12, "u", "\n"), (11, "u", "\n"),
]


def pages(spark, rows):
    names = ["key", "payload", "d", "s", "here", "record_type", "value"]
    frame = spark.createDataFrame([(*r, *names) for r in rows], "page_id long, url string, html string, " + ", ".join(f"c{i} string" for i in range(len(names))))
    return frame.toDF("page_id", "url", "html", *names).repartition(3)


def plain_archive(rows, least=0):
    out = []
    for key, _, html in rows:
        same = [k for k, _, h in rows if (h or "") == (html or "")]
        payload = (html or "").encode()
        first = max((k for k in same if k is not None), default=None)
        revisit = len(payload) >= least and key != first
        out.append((key, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 1, 9, 100])
def test_archives_come_back(spark, tmp_path, least):
    path = f"file://{tmp_path}/a"
    warc.archive(pages(spark, PAGES), path, least=least)
    back = warc.read(spark, path).collect()
    got = sorted(((None if r.key is None else int(r.key), r.payload_bytes, r.payload_digest, r.record_type, None if r.refers_to is None else int(r.refers_to)) for r in back), key=repr)
    assert got == plain_archive(PAGES, least)
    whole = {(k, h or "") for k, _, h in PAGES}
    assert all((None if r.key is None else int(r.key), bytes(r.payload).decode()) in whole for r in back if r.record_type == "response")
    assert {r.url for r in back if r.key == "1"} == {"http://a.example/%20x%0Ay"} and all(r.payload is None for r in back if r.record_type == "revisit")
    files = list((tmp_path / "a").glob("part-*.gz"))
    assert files and all(gzip.open(f).read()[:10] in (b"WARC/1.1\r\n", b"") for f in files)


def test_archives_of_archives(spark, tmp_path):
    """Revisits that come in find their originals, by digest; those of unknown payloads keep what they named."""
    a, b, c = (f"file://{tmp_path}/{x}" for x in "abc")
    warc.archive(pages(spark, PAGES[:4]), f"{a}/one")
    warc.archive(pages(spark, PAGES[4:]), f"{a}/two")
    warc.deduplicate(spark, f"{a}/*", b)
    rows = warc.read(spark, b).collect()
    assert len(rows) == len(PAGES)
    held = {r.payload_digest: r.key for r in rows if r.record_type == "response"}
    assert all(r.refers_to == held[r.payload_digest] for r in rows if r.record_type == "revisit")
    assert {r.payload_digest for r in rows} == {r[2] for r in plain_archive(PAGES)}
    warc.deduplicate(spark, b, c)
    key = lambda found: sorted((str(r.key), r.record_type, str(r.refers_to), r.payload_digest, r.payload_bytes) for r in found)
    assert key(warc.read(spark, c).collect()) == key(rows)
    member = lambda kind, text, more="": gzip.compress(f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{text}{kind}>\r\n{more}Content-Length: {len(text)}\r\n\r\n{text}\r\n\r\n".encode())
    (tmp_path / "d").mkdir()
    digest = "sha1:" + "A" * 32
    (tmp_path / "d" / "x.warc.gz").write_bytes(member("warcinfo", "i") + member("response", "body") + member("response", "bodz") + member("revisit", "", f"WARC-Payload-Digest: {digest}\r\nWARC-Refers-To: <urn:other>\r\n"))
    others = warc.read(spark, f"file://{tmp_path}/d", version="WARC/1.0").collect()
    assert [(r.record_type, r.payload and bytes(r.payload)) for r in others] == [("warcinfo", b"i"), ("response", b"body"), ("response", b"bodz"), ("revisit", None)]
    warc.deduplicate(spark, f"file://{tmp_path}/d", f"file://{tmp_path}/e", version="WARC/1.0")
    assert sorted((r.record_type, r.payload_bytes) for r in warc.read(spark, f"file://{tmp_path}/e").collect()) == [("response", 4), ("response", 4), ("revisit", 0)]


def test_no_pages(spark, tmp_path):
    warc.archive(pages(spark, PAGES).limit(0), f"file://{tmp_path}/n")
    assert warc.read(spark, f"file://{tmp_path}/n").count() == 0


GOOD = " ".join(f"word{i} is here" for i in range(60))
DOCS = [
    (1, GOOD, "a"), (2, GOOD, "a"), (2, GOOD, "b"), (3, GOOD, None), (4, None, ""), (5, "", "a"), (6, "A B", "a"), (7, GOOD + " #", "b"), (8, "the " * 80, "b"), (8, "the " * 80, "b"), (9, GOOD.upper(), "a"),
    (None, GOOD, "a"), (None, GOOD, "a"), (10, " \n\x0b ", "c"), (11, " ".join(f"x{i}" for i in range(30_000)), "c"), (12, " ".join("a" * i for i in range(33)) + " q" * 17, "c"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, None), (3, None, 1), (5, 0, 1), (7, 1, 0), (99, 1, 1), (None, 1, 1), (8, 1, None)]


def plain_audit(docs, labels):
    out = {}
    failures = []
    for key, text, part in docs:
        t = text or ""
        w = brute.words(t)
        fails = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t),
            "E": key is not None and any(k is not None and k < key and (x or "") == t for k, x, _ in docs),
        }
        good, toxic = any(k == key and q == 1 for k, q, _ in labels if k is not None), any(k == key and x == 1 for k, _, x in labels if k is not None)
        failures.append((part or "", fails, good, toxic))
    for part in {f[0] for f in failures}:
        rows = [f[1:] for f in failures if f[0] == part]
        of_filter = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[0][f]]
                left = [r for r in left if not r[0][f]]
                of_filter[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(r[0][f] for r in rows) - len(gone), sum(r[0][f] and sum(r[0].values()) == 1 for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(of_filter[order[step - 1]])
    return out


@pytest.mark.parametrize("block", [1024, 3])
def test_filter_audit(spark, monkeypatch, block):
    monkeypatch.setattr(filter_audit, "BLOCK", block)
    names = ["id", "h", "mask", "n", "part", "salt", "is_first", "good", "toxic"]
    docs = spark.createDataFrame([(*d, *names) for d in DOCS], "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names)).repartition(3)
    labels = spark.createDataFrame([(*x, "x") for x in LABELS], "doc_id long, quality int, toxic int, salt string")
    got = filter_audit.audit(docs, labels).collect()
    assert {(r.part, r.filter_order, r.step): [r[m] for m in filter_audit.MEASURES] for r in got} == plain_audit(DOCS, LABELS) and len(got) == 600 * 4
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    bare = filter_audit.audit(docs, labels.limit(0)).groupBy().agg(F.sum("good_lost") + F.sum("toxic_lost")).first()
    assert bare[0] == 0


def plain_repair(rows):
    """rows: [(turn, role, text)]; figures, audit and repaired turns by trying every edit."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    counts, faults, seen = {"blank": 0, "duplicate": 0, "truncated": 0}, [], set()
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\f\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))
        faults.append(fault)
        if fault:
            counts[fault] += 1
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    after = {"": "sua", "s": "u", "u": "a", "a": "u"}  # what may stand next; the first a needs a u before
    after[""] = "su"
    ways = {("", 0): (0, "", ())}  # (last initial, inserts in a row): best

    def least(into, key, way):
        if key not in into or way < into[key]:
            into[key] = way

    def with_inserts(ways):
        out = dict(ways)
        for _ in range(3):
            for (last, n), (cost, audit, made) in list(out.items()):
                for q, name in (("u", "user"), ("a", "assistant")):
                    if q in after[last] and n < 3:
                        least(out, (q, n + 1), (cost + 3, audit + "I", (*made, (name, ""))))
        return out

    for (_, role, text), fault in zip(rows, faults):
        new = {}
        for (last, _), (cost, audit, made) in with_inserts(ways).items():
            least(new, (last, 0), (cost + 4, audit + "D", made))
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                if role[:1] and role[:1] in after[last]:
                    least(new, (role[:1], 0), (cost + extra, audit + "K", (*made, (role, text))))
                for q, name in (("u", "user"), ("a", "assistant")):
                    if q in after[last]:
                        least(new, (q, 0), (cost + extra + 3, audit + "R", (*made, (name, text))))
        ways = new
    cost, audit, made = min(w for (last, _), w in with_inserts(ways).items() if last in ("", "a"))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
    return (gaps, *counts.values(), illegal, cost, audit, digest), made


def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        here = out.setdefault(conv, [])
        if how == 1:
            text = ""
        if how == 2:
            text = "".join(c for c in text if c not in ".!?")
        here += [(turn, "user" if how == 4 else role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
    return out


def talks():
    import random

    rng = random.Random(5)
    rows = []
    for conv in range(300):
        for i in range(rng.randint(1, 9)):
            turn = rng.choice([i, i, i, i * 3, None, 0])
            rows.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]), rng.choice(["Yes.", f"n{i}.", "cut", "is it?!", "", " \n", None, f"{i} 　", "Well. \n\n", "é"])))
    rows += [(None, 1, "user", "hi."), (None, None, "assistant", "x"), (None, 1, "user", "hi."), (1000, -(2**63), "user", "a."), (1000, 2**63 - 1, "assistant", "b.")]
    return rows + [(2000, i, "ua"[i % 2] if i % 7 else "s", f"turn {i}" + "." * (i % 5 > 0)) for i in range(3_000)] + [(2001, 0, "assistant", "long " * 200_000)]


def test_repair(spark):
    rows = talks()
    names = ["conv", "number", "again", "fault", "how"]
    table = spark.createDataFrame([(*r, *names) for r in rows], "conv_id long, turn long, role string, text string, " + ", ".join(f"{n} string" for n in names)).repartition(5)
    damaged = conversation.damage(table)
    got = {r.conv: r for r in conversation.repair(damaged, present="present").collect()}
    made = {}
    for r in conversation.repaired(damaged, present="present").collect():
        made.setdefault(r.conv, []).append((r.place, r.role, r.text))
    plain = plain_damage(rows)
    assert set(got) == set(plain)
    for conv, turns in plain.items():
        figures, turns_made = plain_repair(turns)
        assert (min(figures[0], 2**63 - 1), *figures[1:]) == tuple(got[conv])[1:], (conv, turns if len(turns) < 20 else "")
        assert [x[1:] for x in sorted(made.get(conv, []))] == list(turns_made)


def test_no_turns(spark):
    rows = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert conversation.repair(rows).collect() == conversation.repaired(rows).collect() == []
    one = conversation.repair(spark.createDataFrame([("k", 3, None, "")], rows.schema)).first()
    assert tuple(one) == ("k", 0, 1, 0, 0, 0, 4, "D", hashlib.sha256(b"").hexdigest())


def test_queries_name_what_they_return(spark):
    d = "/root/testdata/sf0.001"
    assert queries.op11_warc(spark, d).dtypes == [("page_id", "bigint"), ("payload_bytes", "bigint"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", "bigint")]
    assert queries.op12_filter_audit(spark, d).columns == ["part", "filter_order", "step", *filter_audit.MEASURES]
    assert queries.op13_conversation_repair(spark, d).columns[0] == "conv_id"
