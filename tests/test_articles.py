"""Article parser against a plain re-reading of the rules, on invented texts."""

import re
import unicodedata

from pyspark.sql import functions as F

from corpusloom.functions import article, fixed
from corpusloom.functions.text import clean_text, nfc, safe_stem, strip
from corpusloom.operators import documents


def clean(t):
    for a, b in fixed.TEXT_REPAIRS:
        t = t.replace(a, b)
    t = " ".join(t.replace("|", " ").split())
    return re.sub(r" ([.,;:!?])", r"\1", t).strip()


LONG = "Một đoạn văn đủ dài để được giữ lại trong phần này của bài viết mẫu"
HEAD = f"TIÊU ĐỀ: Bệnh mẫu\nURL: https://example.org/a\n{fixed.RULE}\n\n"
PEOPLE = "Theo\n\nAnna Nguyen,\n\nMD\n\nCity University\n\nXem xét bởi\n\nBinh Tran\n\nMD\n\n"
REVISION = "Đã xem xét/Đã chỉnh sửa\n\nThg 7 2024\n\n|\n\nv123_vi\n\n"

TEXTS = {
    "full, one.txt": HEAD + "NỘI DUNG:\n\nBệnh mẫu\n\n" + PEOPLE + REVISION
    + f"Mở đầu có hành v i lạ .\n\n(Xem thêm\n\nTổng quan về các bệnh mẫu hiếm gặp\n\n.)\n\nCăn nguyên\n\nA {LONG}.\n\nChẩn đoán\n\nÂ {LONG} hai.\n\n"
    f"Điều trị Phòng ngừa Xin {LONG}\n\nCăn nguyên\n\nB {LONG} ba.\n\nTest your Knowledge\n\nBản quyền\n© 2025",
    "no revision.txt": HEAD + "NỘI DUNG:\n\nTheo\n\nAn\n\nMD,\n\nLời đầu tiên\n\nThg mười vẫn được giữ\n\nMerck & Co. và hơn nữa",
    "no mark.txt": "Chỉ là văn bản | thô  \n\n" + f"| Căn nguyên | {LONG} một || Điều trị |\n {LONG} hai",
    "nbsp.txt": HEAD + f"NỘI DUNG: {REVISION}Điều trị  Ê {LONG} ; xong \x1c.",
    "only header words.txt": HEAD + "NỘI DUNG:\n\nTheo MD,\n\nThg 3",
    "refs.txt": HEAD + "NỘI DUNG:\n" + "".join(
        f"(Xem thêm mục tham khảo số {i % 12} của bài viết mẫu và xem phần bổ sung số {i % 3} của bài viết khác.)" for i in range(30)
    ),
    "+ plus.txt": HEAD + "NỘI DUNG:\n\n" + "Footer muộn © 2023 rồi Bản quyền ở sau",
    "five lines.txt": "1\n2\n3\n4\n5\nTIÊU ĐỀ: quá muộn\nNỘI DUNG: x",
    "twice.txt": "TIÊU ĐỀ: một\nTIÊU ĐỀ: hai TIÊU ĐỀ: ba\nURL:\nNỘI DUNG:\n\nĐiều trị thường Triệu chứng và Dấu hiệu A " + LONG,
}


def one_name(block, organisations):
    """Names are lines of 6 to 49 characters with a letter that are neither a
    degree nor an organisation; the first one counts."""
    plausible = [
        x for x in map(str.strip, block.splitlines())
        if 6 <= len(x) <= 49 and x not in fixed.DEGREES and re.search(r"[^\W\d_]", x) and not re.search("|".join(organisations), x)
    ]
    return [n.rstrip(",").strip() for n in plausible[:1]]


def between(text, lead, *ends):
    """What stands between a lead and the nearest of the ends behind it."""
    for start in (m.end() for m in re.finditer(lead + r"\s+", text)):
        stops = [text.index(e, start) for e in ends if e in text[start:]]
        if stops:
            return text[start : min(stops)]
    return ""


def sections_of(content):
    starts = {}
    for head in fixed.SECTION_HEADERS:
        free = 0  # pipes before are taken by the header itself
        for m in re.finditer(re.escape(head), content):
            rest = content[m.end():]
            gap = len(rest) - len(rest.lstrip())
            near = rest[gap : gap + 50]
            left = content[: m.start()].rstrip()
            if left.endswith("|") and len(left) > free and near.startswith("|"):
                starts[m.end() + gap + 1] = head
                free = m.end() + gap + 1
            elif gap and re.match(f"[{fixed.SECTION_CAPITALS}]", near) and sum(h in near for h in fixed.SECTION_HEADERS if h != head) == 0:
                starts[m.end() + gap] = head
    places = sorted(starts) + [len(content)]
    found = {}
    for here, there in zip(places, places[1:]):
        part = content[here:there].strip().lstrip("| \n\t")
        if 51 <= len(part) <= 19999:
            found[starts[here]] = clean(part)
    return list(found.items())


def body_of(text):
    _, mark, body = text.partition(fixed.BODY_MARK)
    if not mark:
        return text
    with_revision = re.split(r"(?s)Đã xem xét/Đã chỉnh sửa.*?v\d+_vi", body, maxsplit=1)
    if len(with_revision) == 2:
        body = with_revision[1]
    else:
        lines = [x.strip() for x in body.splitlines() if x.strip()]
        plain = [i for i, x in enumerate(lines) if not re.search("|".join(fixed.HEADER_WORDS), x)]
        body = " ".join(lines[plain[0]:]) if plain else ""
    present = [f for f in fixed.FOOTERS if f in body]
    return clean(body.partition(present[0])[0] if present else body)


def brute(name, text):
    def value(mark):
        return ([""] + [x.replace(mark, "").strip() for x in text.split("\n")[:5] if x.startswith(mark)])[-1]

    groups = re.findall(r"\(Xem thêm\s+([^)]+)\)", text)
    pieces = [p.strip(". ") for g in groups for p in re.split(r"\s+và\s+(?:xem\s+)?", g)]
    refs = [clean(p) for p in pieces if 21 <= len(p) <= 149 and not re.search("|".join(fixed.REFERENCE_STOPS), p)]
    content = body_of(text)
    return (
        name[:-4].lower().translate({ord(" "): "_", ord(","): None}), value(fixed.TITLE_MARK), value(fixed.URL_MARK), content,
        one_name(between(text, fixed.AUTHOR_LEAD, fixed.REVIEWER_LEAD, fixed.REVIEWED), fixed.AUTHOR_ORGANISATIONS),
        one_name(between(text, fixed.REVIEWER_LEAD, fixed.REVIEWED), fixed.REVIEWER_ORGANISATIONS),
        sorted(set(refs), key=refs.index)[:10], sections_of(content),
    )


def test_documents(spark, tmp_path):
    from corpusloom.sources.files import read_article_files

    for name, text in TEXTS.items():
        (tmp_path / name).write_bytes(text.replace("\n", "\r\n").encode())
    (tmp_path / "broken.txt").write_bytes(b"\xff\xfe\xff")
    (tmp_path / "other.json").write_text("{}")
    good, bad = read_article_files(spark, str(tmp_path))
    assert [r.file_name for r in bad.collect()] == ["broken.txt"]
    got = {
        r.id: (r.id, r.title, r.url, r.content, r.authors, r.reviewers, r["references"], list(r.sections.items()))
        for r in documents.parse_articles(good, "site").collect()
    }
    for name, text in TEXTS.items():
        want = brute(name, text)
        assert got[want[0]] == want, name
    assert len(got) == len(TEXTS)
    assert got["full_one"][4] == ["Anna Nguyen"] and got["full_one"][5] == ["Binh Tran"]
    assert got["full_one"][7][0][0] == "Căn nguyên" and "ba." in got["full_one"][7][0][1]


def test_no_python_in_parser_plan(spark):
    files = spark.createDataFrame([("a.txt", "x")], "file_name string, value string")
    plan = documents.parse_articles(files, "site")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_text_functions(spark):
    df = spark.createDataFrame([("  a \x1d b ,c | d\t.\n",), (None,), ("hành v i  x",)], "t string")
    got = [r[0] for r in df.select(clean_text("t")).collect()]
    assert got == ["a b,c d.", "", "hành vi x"]
    assert df.select(strip("t")).first()[0] == "a \x1d b ,c | d\t."
    assert df.select(safe_stem(F.lit("Đau! (bụng)_2-x²"))).first()[0] == "Đau bụng_2-x²"
    nfd = unicodedata.normalize("NFD", " tiếng Việt ")
    assert spark.createDataFrame([(nfd,)], "t string").select(nfc("t")).first()[0] == "tiếng Việt"
    assert df.select(article.before_footer(F.lit("a © 2023 b Bản quyền"))).first()[0] == "a © 2023 b "


def test_instruction_rows_and_statistics(spark):
    long = "x" * 501
    docs = spark.createDataFrame(
        [("1", "T", "u", long, ["A"], [], ["r"], {"Điều trị": "y" * 51, "Tiên lượng": "z" * 50}), ("2", "S", "v", "c" * 500, [], [], [], {})],
        "id string, title string, url string, content string, authors array<string>, reviewers array<string>, "
        "references array<string>, sections map<string,string>",
    )
    rows = documents.instruction_rows(docs).collect()
    assert [(r.instruction, len(r.output), r.metadata.section) for r in rows] == [
        ("T là gì?", 503, None), ("Giải thích về điều trị của T", 51, "Điều trị"), ("S là gì?", 500, None)
    ]
    s = documents.statistics(docs).first()
    assert (s.documents, s.characters, s.characters_per_document, s.sections, s["references"], s.with_author, s.with_reviewer) == (2, 1001, 500, 2, 1, 1, 0)
    empty = documents.statistics(docs.limit(0)).first()
    assert (empty.documents, empty.characters, empty.characters_per_document) == (0, 0, 0)


def test_wide_gaps_and_repeated_headers(spark):
    """Gaps before a header count as text, however wide; a pipe serves one header of a name."""
    a, b, c = (h for h in fixed.SECTION_HEADERS if h in ("Căn nguyên", "Sinh lý bệnh", "Điều trị"))
    texts = []
    for gap in (0, 1, 49, 50, 99, 100, 101, 150, 300, 20_000):
        texts.append(f"x | {a} | ngan |{' ' * gap}{b} | " + "phần thân của mục " * 5)
        texts.append(f"| {a} |" + "y" * 60 + "|" + " \n" * (gap // 2) + f"{b} | " + "z " * 40 + f"|{' ' * gap}{c} Khi đó " + "w " * 30)
        texts.append(f"|{' ' * gap}{a} | {a} |{' ' * gap}{a} | {a}| {a} | " + "một đoạn dài " * 6)
    texts += [f"| {a} " * n + "| " + "đoạn " * 15 for n in (1, 2, 3, 4, 5)] + [f"| {a} | {b} | {a} | {a} | Nội dung " + "t " * 40]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = rows.select("i", article.section_map(article.section_entries(F.col("t"))).alias("m")).collect()
    for r in got:
        assert list(r.m.items()) == list(dict(sections_of(texts[r.i])).items()), r.i


def test_strip_removes_every_kind_of_white_space(spark):
    rows = [(chr(i),) for i in range(1, 0x3100)]
    marked = spark.createDataFrame(rows, "c string").select("c", strip(F.concat("c", F.lit(" x"), "c", F.lit("y "), "c")).alias("s"))
    for r in marked.collect():
        space = bool(re.fullmatch(r"\s", r.c))  # Python's is Unicode white space and U+001C to U+001F
        assert r.s == (f"x{r.c}y" if space else f"{r.c} x{r.c}y {r.c}"), hex(ord(r.c))


def test_cleaned_text_is_not_cleaned_again(spark):
    text = "một hai v i ba bốn năm sáu bảy ớn lạnh tám chín mười , xyz . "
    raw = ["A Căn nguyên  " + "B" + text + "|\n\t Điều trị | " + text + "Tiên lượng C" + text, "Căn nguyên A" + text + "﷒ b ﷓ c", "", None]
    docs = spark.createDataFrame([(t,) for t in raw], "t string").select(clean_text("t").alias("c")).cache()
    cleaned = article.section_entries(F.col("c"), F.lit(True))
    got = docs.select(cleaned.alias("a"), article.section_entries(F.col("c")).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and [len(r.a) for r in got] == [2, 1, 0, 0]
    wide = spark.createDataFrame([("Căn nguyên A" + "  b" * 30,)], "t string").select(article.section_entries(F.col("t"), F.lit(True)).alias("a"))
    assert wide.first().a[0].text == "A" + "  b" * 30


def test_header_lines_line_by_line(spark):
    lines = ["Theo x", " Thg 7", "\t", "", "v_vi 😀", "😀 text ", "  ", "University", "end\r", "a  b"]
    texts = ["\n".join(lines[i:j]) for i in range(len(lines)) for j in range(i, len(lines) + 1)]

    def direct(text):
        kept = [x for x in map(str.strip, text.split("\n")) if x]
        first = next((i for i, x in enumerate(kept) if not any(w in x for w in fixed.HEADER_WORDS)), len(kept))
        return " ".join(kept[first:])

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(article.after_header_lines(F.col("t"))).collect()] == [direct(t) for t in texts]
    revised = [f"a{fixed.REVISION_LEAD}b{fixed.REVISION_LEAD} v1 v23_vi😀 c v4_vi", f"{fixed.REVISION_LEAD}v_vi", "v1_vi", f"v1_vi{fixed.REVISION_LEAD}v2_vi"]
    got = spark.createDataFrame([(t,) for t in revised], "t string").select(article.after_revision(F.col("t"))).collect()
    assert [r[0] for r in got] == ["😀 c v4_vi", None, None, ""]
