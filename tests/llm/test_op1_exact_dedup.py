import hashlib
import re
from collections import Counter

from lakeshore.llm import exact_dedup


def spec(rows):
    groups = {}
    for i, row in enumerate(rows):
        text = row[1] or ""
        key = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", text).encode()).hexdigest()
        groups.setdefault(key, []).append((-len(text), row[0] is None, row[0] or 0, i))
    out = []
    for key, members in groups.items():
        best = min(members)
        out += [(None if m[1] else m[2], None if best[1] else best[2], len(members), key) for m in members]
    return Counter(out)


def test_groups_match_brute_force(odd, odd_rows, clash):
    for df in (odd, clash(odd)):
        for hot in (1, 1024):       # with few and many candidates of the summary
            got = exact_dedup.duplicate_groups(df, max_hot=hot).collect()
            assert Counter((r["id"], r["keep_id"], r["group_size"], r["digest"]) for r in got) == spec(odd_rows)
            kept = Counter(r["digest"] for r in got if r["kept"])
            assert set(kept.values()) == {1} and len(kept) == len({r["digest"] for r in got})


def test_heavy_group(spark):
    rows = [(i, "hot text" if i % 3 else f"text {i // 6}", "en", "s", 1) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(7)
    got = exact_dedup.duplicate_groups(df).collect()
    assert Counter((r["id"], r["keep_id"], r["group_size"], r["digest"]) for r in got) == spec(rows)


def test_documents_that_stay(odd, odd_rows, clash):
    df = clash(odd)
    got = exact_dedup.dedup_documents(df)
    assert got.columns == df.columns
    rows = got.collect()
    digests = [hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "").encode()).hexdigest() for r in rows]
    assert len(digests) == len(set(digests)) == len({k[3] for k in spec(odd_rows)})


def test_empty(empty, clash):
    assert exact_dedup.duplicate_groups(empty).count() == 0
    assert exact_dedup.dedup_documents(clash(empty)).count() == 0
