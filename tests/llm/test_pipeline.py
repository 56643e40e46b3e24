import zlib

import brute
import corpus_pipeline as P
import pandas as pd
from brightloom.llm import quality


def brute_pipeline(docs, items):
    """Document ids and texts after the first four stages."""
    kept = {}
    for d, t in docs.items():
        *_, failed = brute.quality(t)
        w = brute.words(t)
        stops = sum(x in quality.STOP_FORMS for x in w)
        lines = [x for x in (t or "").split("\n") if brute.WORD.search(x)]
        dup = len(lines) - len(set(lines))
        if not failed and stops / len(w) >= 0.02 and sum(c in "#*$%&|<>" for c in t) / len(w) <= 0.25 and dup / max(1, len(lines)) <= 0.5:
            kept[d] = t
    lines = brute.remove_lines(kept)
    lines = {d: t for d, t in lines.items() if brute.WORD.search(t)}
    groups = brute.components({d: brute.simhash(t) for d, t in lines.items()})
    lines = {d: lines[d] for d in set(groups.values())}
    return {d: lines[d] for d, (_, hit, _) in brute.decontaminate(lines, items).items() if not hit}


def text(seed, n, line=9):
    words = "the of and to in is that for it with river stone mountain paper window garden letter winter summer yellow silver market island".split()
    state, out = zlib.crc32(str(seed).encode()), []
    for i in range(n):
        state = (state * 1103515245 + 12345) % 2**31
        out.append(words[state >> 8 & 15] + (str(state % 977) if state >> 5 & 1 else ""))
        out.append("\n" if i % line == line - 1 else " ")
    return "".join(out).strip()


def test_stages_against_plain_version(spark, tmp_path):
    docs = [(i, text(i, 60 + 7 * i), "en", f"s{i % 3}") for i in range(30)]
    docs += [(100, docs[3][1], "en", "s0"), (101, docs[4][1] + "\n" + text("x", 40), "en", None), (102, "# | * %", "en", "s1"), (103, None, "en", "s1"), (104, "", None, "s2")]
    leak = text("bench", 30, 99)
    docs.append((105, text("y", 80) + " " + leak + " " + text("z", 80), "en", "s2"))
    frame = pd.DataFrame(docs, columns=["doc_id", "text", "lang", "source"])
    frame["n_chars"] = [len(t or "") for t in frame.text]
    spark.createDataFrame(frame.astype({"n_chars": "int64"}), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = brute_pipeline({d: t for d, t, *_ in docs}, {1: leak, 2: None})
    assert 105 not in want and 100 not in want and len(want) > 20
    rows = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = rows.columns
    for _, stage in P.STAGES[:4]:
        rows = stage(spark, rows, str(tmp_path))
        assert rows.columns == columns
    got = {r.doc_id: r.text for r in rows.collect()}
    assert got == want
    mixed = P.run(spark, str(tmp_path)).toPandas()
    assert set(mixed.doc_id) <= set(want)
    whole = mixed[[len(brute.words(want[d])) == w for d, w in zip(mixed.doc_id, mixed.mix_words)]]
    assert all(t == want[d] for d, t in zip(whole.doc_id, whole.text)) and len(whole) > 20
    total = sum(len(brute.words(t)) for t in want.values())
    assert abs(mixed.mix_words.sum() - 1.5 * total) < 200
