import random
import re
from collections import Counter, defaultdict

from tierflow.llm.queries import QUERIES
from tierflow.llm.quality_rules import apply_quality_rules, remove_boilerplate


def normal(line):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in line)
    return re.sub(r"[\x20\x09-\x0D]+", " ", low).strip(" ")


def brute(rows, min_docs):
    by_line = defaultdict(set)
    for _, text, host in rows:
        text, host = text or "", host or ""
        for line in text.split("\n"):
            if normal(line):
                by_line[host, normal(line)].add(text)
    bad = {k for k, v in by_line.items() if len(v) > min_docs}
    out = []
    for doc_id, text, host in rows:
        text, host = text or "", host or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        covered = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
        gone = sum(len(normal(x).split(" ")) for x in lines if (host, normal(x)) in bad)
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        out.append(
            (doc_id, len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"),
             len(lines) - len(set(lines)), len(covered), failed, gone,
             not failed and len(words) - gone >= 0.5 * len(words))
        )
    return out, bad


def make():
    rng = random.Random(5)
    rows = []
    for i in range(120):
        lines = [" ".join(rng.choice(["Aa", "b", "cé", "d#", "漢"]) + str(rng.randint(0, 9)) for _ in range(rng.randint(0, 9)))
                 for _ in range(rng.randint(1, 20))]
        lines += [rng.choice(["Share this  page", "share THIS\tpage ", "x" * 40])] * rng.randint(0, 2)
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), rng.choice(["h1", "h1", "h2", None])))
    rows += [(200 + i, " ".join(f"w{j}" for j in range(60)) + "\nown " + str(i), "h3") for i in range(12)]
    rows += [(300, "copy of one text\nsecond line", "h4")] * 9
    return rows + [(None, None, None), (1, "", "h1"), (1, "", "h1"), (400, "a b c " * 5000, "h5"), (401, "a b\x0b\x1fc", "h5")]


def test_against_brute_force(spark):
    rows = make()
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, source string, kept int")
    expected, bad = brute(rows, 3)
    found = apply_quality_rules(frame, min_docs=3)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)
    assert any(r[7] for r in expected) and any(not r[8] and not r[6] for r in expected)
    cleaned = remove_boilerplate(frame, min_docs=3).collect()
    left = Counter()
    for doc_id, text, host in rows:
        text = text or ""
        lines = [x for x in text.split("\n") if not normal(x) or ((host or ""), normal(x)) not in bad]
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text))
        if len(re.findall(r"[^\x20\x09-\x0D]+", "\n".join(lines))) >= 0.5 * n:
            left[doc_id, "\n".join(lines)] += 1
    assert Counter(map(tuple, cleaned)) == left


def test_empty_table_and_plan(spark):
    frame = spark.createDataFrame([], "doc_id bigint, text string, source string")
    found = apply_quality_rules(frame)
    assert found.count() == 0
    assert "Python" not in found._jdf.queryExecution().toString()


def test_large_and_small_hosts_are_judged_alike(spark):
    """One host of 6,000 documents and one of 30: a line of 21 of them goes in both, one of 20 stays."""
    rows = []
    for host, size in (("large", 6000), ("small", 30)):
        for i in range(size):
            own = " ".join(f"{host}{i}w{j}" for j in range(30))
            more = "\n" + " ".join(f"often{j}" for j in range(40)) if i < 21 else ""
            more += "\nless often by one" if i < 20 else ""
            rows.append((len(rows), own + more, host))
    found = apply_quality_rules(spark.createDataFrame(rows, "doc_id int, text string, source string"))
    removed = Counter((r.n_removed_words, r.kept) for r in found.filter("n_words > 30").collect())
    assert removed == {(40, False): 42}


def test_fewer_documents_are_enough_where_they_are_a_share_of_the_host(spark):
    """Lines of 5, 6 and 21 documents in hosts of 30 and of 6,000, and of 7 in the larger."""
    rows = []
    for host, size in (("large", 6000), ("small", 30)):
        for i in range(size):
            own = " ".join(f"{host}{i}w{j}" for j in range(60))
            more = "".join(f"\nseen in {'x ' * n}" for n in (5, 6, 7, 21) if i < n)
            rows.append((len(rows), own + more, host))
    frame = spark.createDataFrame(rows, "doc_id int, text string, source string")
    few = apply_quality_rules(frame, few_docs=5).filter("doc_id in (0, 6, 6000, 6005)")
    assert {r.doc_id: r.n_removed_words for r in few.collect()} == {0: 9 + 23, 6: 9 + 23, 6000: 8 + 9 + 23, 6005: 8 + 9 + 23}
    assert {r.n_removed_words for r in apply_quality_rules(frame).filter("doc_id in (0, 6000)").collect()} == {23}


def test_registered_query_has_both_limits(spark, tmp_path):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(60)) + "\nsix have it" * (i < 6), "host") for i in range(30)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op1_quality_rules"](spark, str(tmp_path))
    assert found.filter("n_removed_words = 3").count() == 6
