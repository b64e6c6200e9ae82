from conftest import rows
from pyspark.sql import functions as F

from lexmill.llm import scans as S

RAW = "filename string, court string, raw_pages array<string>, n_pages int, ingested_at int"
PROC = "filename string, court string, header string, kind string"
BODY = ["Žalovaný zaplatil dohodnutú zmluvnú pokutu riadne a včas", "Okresný súd rozhodol podľa zákona o zmluvnej pokute", "právno-záväzkový vzťah strán trval do konca roka"]


def fixture(spark):
    raw, head = [], []
    for i in range(30):
        name = f"OS_Zelenec_{i}Cbi_{100 + i}_2015_00_dokument.pdf"
        top = f"Okresný súd Zelenec {i}Cbi/{100 + i}/2015"
        one = [top, "Súd: Okresný súd Zelenec", f"Spisová značka: {i}Cbi/{100 + i}/2015", *BODY, "- 1 -"]
        two = [top, *BODY, f"Spis {i}Cbi/{100 + i}/2015", f"{i}Cbi/{100 + i}/2015.", "121", "Strana 2"]
        if i == 0:
            one[3:5] = ["Žalovaný zaplatil dohodnutú zmluvnú p0kutu riaclne a včas", "Okresný súd rozho-", "dol podľa zákona o zmluvnej po‐", "kute právno-", "záväzkový vzťah"]
        raw.append((name, "Okresný súd Zelenec" if i % 3 else None, ["\n".join(one), None if i == 5 else "\n".join(two)], 2, 1))
        head.append((name, "Okresný súd Zelenec", f"{top}\nSúd: Okresný súd Zelenec\nOdoslať odkaz\nstr. 1", "x"))
    raw.append(raw[0][:4] + (2,))
    raw.append(("z.pdf", None, None, 0, 1))
    raw.append(("y.pdf", None, [], 0, 1))
    return spark.createDataFrame(raw, RAW), spark.createDataFrame(head + [("n.pdf", None, None, "x")], PROC)


def test_every_kind(spark):
    raw, proc = fixture(spark)
    got = rows(S.found(S.inputs(raw, proc)))
    first = [r[2:] for r in got if r[0] == "raw_pages" and r[1].startswith("OS_Zelenec_0C")]
    want = [(0, 0, "running_header"), (0, 3, "misread"), (0, 4, "hyphen_break"), (0, 5, "hyphen_break"), (0, 9, "page_number"), (1, 0, "running_header"), (1, 7, "page_number")]
    assert sorted(first) == want
    head = [r[2:] for r in got if r[0] == "header" and r[1].startswith("OS_Zelenec_1C")]
    assert sorted(head) == [(-1, 0, "running_header"), (-1, 3, "page_number")]
    assert len(got) == len(set(got))


def test_restored(spark):
    raw, proc = fixture(spark)
    text = [r["paragraph"] for r in S.restored(S.inputs(raw, proc)).where("field_name = 'raw_pages' AND filename LIKE 'OS\\_Zelenec\\_0C%'").orderBy("paragraph_no").collect()]
    whole = " ".join(text)
    assert "zmluvnú pokutu riadne" in whole and "rozhodol podľa" in whole and "právno- záväzkový" in whole and "Strana 2" not in whole and "- 1 -" not in whole


def test_empty(spark):
    raw, proc = fixture(spark)
    assert rows(S.found(S.inputs(raw.limit(0), proc.limit(0)))) == []


def test_page_numbers_and_edits():
    assert S.is_page_number("S t r a n a  1", 1) and S.is_page_number("Strana l", 1) and S.is_page_number("2 | 3", 2) and not S.is_page_number("121", 2) and not S.is_page_number("Počet dní 1", 1)
    assert "pokuta" in S.edits("p0kuta") and "odporca" in S.edits("oclporca") and "škoda" in S.edits("5koda")
    assert S.canon("Okresriý") == S.canon("Okresný") and S.canon("súcl") == S.canon("súd")
    assert S.inputs.__doc__ and F is not None
