import random
from collections import defaultdict

from conftest import rows

from lexmill.llm import site_lines as L


def brute(data, share=0.2, least=3):
    norm = lambda x: (lambda s: s[next((i for i, c in enumerate(s) if c.isalnum()), len(s)) : len(s) - next((i for i, c in enumerate(reversed(s)) if c.isalnum()), 0)])(" ".join(x.lower().split()))
    files, docs = defaultdict(set), defaultdict(set)
    for s, d, t in data:
        if s is not None:
            files[s].add(d)
            for line in (t or "").split("\n"):
                if not line.startswith(L.LABELS) and norm(line):
                    docs[s, norm(line)].add(d)
    heavy = {k for k, v in docs.items() if len(v) >= least and len(v) >= share * len(files[k[0]])}
    return sorted({(d, i) for s, d, t in data if s is not None for i, line in enumerate((t or "").split("\n")) if not line.startswith(L.LABELS) and (s, norm(line)) in heavy})


def frame(spark, data):
    return spark.createDataFrame([(s, d, t, "x", 1) for s, d, t in data], "court string, filename string, header string, norm string, line_no int")


def make(n, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        s = r.choice(["big"] * 6 + ["b", "c", None])
        lines = [f"own {i}", "Súd: x", f"  {'Share' if r.random() < 0.5 else 'SHARE'}  this! " if r.random() < 0.3 else "", "rare" if r.random() < 0.05 else f"note {i % 7}", "***"]
        r.shuffle(lines)
        out.append((s, f"f{i}", "\n".join(lines) if r.random() > 0.05 else None))
    return out


def test_against_brute_force(spark):
    data = make(400)
    assert rows(L.found_lines(frame(spark, data).repartition(9), "court", "filename", "header")) == sorted(brute(data), key=str)


def test_redelivery_counts_once_and_takes_the_exact_way(spark):
    data = make(60)
    many = data + [data[0]] * 3000
    assert rows(L.found_lines(frame(spark, many), "court", "filename", "header")) == sorted(brute(data), key=str)


def test_cleaned_and_edges(spark):
    data = [("a", f"f{i}", f"Own {i}\nShare!\nSúd: x") for i in range(5)] + [("a", "n", None), (None, "m", "Share!"), ("e", "e", "")]
    out = {r["filename"]: r["clean_text"] for r in L.cleaned(frame(spark, data), "court", "filename", "header").collect()}
    assert out["f0"] == "Own 0\nSúd: x" and out["n"] is None and out["m"] == "Share!" and out["e"] == ""
    assert rows(L.found_lines(frame(spark, data).limit(0), "court", "filename", "header")) == []
