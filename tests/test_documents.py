"""Terms, layout, rendering, translation, exchange and streams against plain versions."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import assembly as A, blocks as B, layout as L, rendering as R, terms as G, translation as X
from foliant.sources import exchange, glossary
from foliant.streaming import assembly as S

RANDOM = random.Random(4)


def test_terms(spark):
    """The longest form wins, matches don't overlap, an abbreviation needs its own case but takes its words in any."""
    terms = spark.createDataFrame([("cell", "cell", "", ""), ("stem cell", "stem cell", "", "SC"), ("c-reactive protein", "C-reactive protein", "", "CRP"), ("crp test", "crp test", "", ""), ("os", "os", "bone | Bone tissue", "")], "key string, en string, variants string, abbr string")
    forms = G.surface_forms(terms)
    got = {(r.lookup, r.key, r.words) for r in forms.collect()}
    assert {("SC", "stem cell", 1), ("stem cells", "stem cell", 2), ("bones", "os", 1), ("bone tissues", "os", 2), ("c-reactive proteins", "c-reactive protein", 2), ("oses", "os", 1)} <= got
    texts = spark.createDataFrame([(1, "Stem cells, a cell; sc and SC."), (2, "C-Reactive Protein or crp, pre-cell"), (3, ""), (4, None), (5, "(CRP test) the cell; stem  cell"), (6, "stem, cell")], "id int, text string")
    met = G.match_terms(texts, forms, ["id"]).collect()
    found = {i: [r.key for r in sorted((m for m in met if m.id == i), key=lambda r: r.at)] for i in range(1, 7)}
    assert found == {1: ["stem cell", "cell"], 2: ["c-reactive protein"], 3: [], 4: [], 5: ["crp test", "cell"], 6: ["cell"]}
    assert G.match_terms(texts, forms.limit(0), ["id"]).count() == 0


def test_first_mentions(spark):
    blocks = spark.createDataFrame([(1, 0, "heading", 1), (1, 1, "label", 0), (1, 2, "para", 0), (1, 3, "para", 0), (1, 4, "heading", 3), (1, 5, "para", 0), (1, 6, "heading", 2), (1, 7, "para", 0)], "doc_id int, block int, kind string, level int")
    mentions = spark.createDataFrame([(1, b, t, t == "b") for b in (1, 2, 3, 5, 7) for t in "ab"], "doc_id int, block int, term string, ambiguous boolean")
    got = {(r.block, r.term): r.first for r in B.first_mention(mentions, blocks).collect()}
    assert [b for b in (1, 2, 3, 5, 7) if got[b, "a"]] == [1, 2, 7] and not any(got[b, "b"] for b in (1, 2, 3, 5, 7))
    assert not any(r.first for r in B.first_mention(mentions, blocks, bilingual=False).collect())


def test_glossary_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("# c\n\nen\tvi\tvariants\tambiguous\nCell\tté\tx|y\tyes\r\nnone\t\t\t\nbone\tx\t\t0\n", encoding="utf-8")
    (tmp_path / "b.tsv").write_text("vi\ten\tstatus\nnew\tCELL\tapproved\n", encoding="utf-8")
    terms = glossary.reloaded(glossary.read(spark, str(tmp_path)))
    got = {r.key: (r.en, r.vi, r.variants, r.ambiguous, r.status) for r in terms.collect()}
    assert got == {"cell": ("CELL", "new", "", False, "approved"), "bone": ("bone", "x", "", False, "draft")}
    changed = G.upsert(terms, terms.limit(1).selectExpr("key", "' Bone ' as en", "' y' as vi", "variants", "abbr", "domain", "ambiguous", "status", "note", "source").select(*terms.columns))
    assert {r.key: r.vi for r in changed.collect()} == {"cell": "new", "bone": "y"}
    with pytest.raises(Exception, match="needs en and vi"):
        G.upsert(terms, terms.limit(1).withColumn("vi", F.lit(" "))).collect()
    glossary.write(changed, str(tmp_path / "out"))
    again = glossary.reloaded(glossary.read(spark, str(tmp_path / "out" / "part-*")))
    assert {r.key: r.vi for r in again.collect()} == {"cell": "new", "bone": "y"}
    assert [r.key for r in G.search(changed, "E").collect()] == ["bone", "cell"] and G.search(changed, "").count() == 2


def plain_closure(boxes):
    """Unites any two that meet, until no two do."""
    boxes = {tuple([*b, n]) for n, b in enumerate(boxes)}
    while pair := next(((a, b) for a, b in itertools.combinations(boxes, 2) if max(a[0], b[0]) < min(a[2], b[2]) and max(a[1], b[1]) < min(a[3], b[3])), None):
        low, high = zip(*(x[:2] for x in pair), strict=True), zip(*(x[2:4] for x in pair), strict=True)
        boxes = (boxes - set(pair)) | {(*map(min, low), *map(max, high), pair[0][4])}
    return sorted(([*b[:4]] for b in boxes), key=lambda b: (b[1], b[0]))


def test_closure():
    for _ in range(300):
        boxes = []
        for _ in range(RANDOM.randint(0, 9)):
            x, y = RANDOM.randrange(30), RANDOM.randrange(30)
            boxes.append([x, y, x + RANDOM.randint(1, 9), y + RANDOM.randint(1, 9)])
        assert L.closure(boxes) == plain_closure(boxes)


def test_spans(spark):
    rows = [(0, 0, "Hy", 10.04, 1, True), (0, 1, "phen-", 12.0, 2, False), (1, 0, "ated", 12.0, 2, False), (1, 1, "   ", 30.0, 9, True), (2, 0, "• item", 10.0, 1, True), (3, 0, " ", 50.0, 3, True)]
    spans = spark.createDataFrame([(1, 1, 0, *r) for r in rows] + [(1, 1, 1, 0, 0, "  ", 5.0, 0, False)], "doc_id int, page int, block int, line int, span int, text string, size double, color int, bold boolean")
    got = L.blocks_of_spans(spans).collect()
    assert [(r.block, r.text, r.size, r.color, r.lines, round(r.bold, 3)) for r in got] == [(0, "Hyphenated\n• item", 12.0, 2, 3, round(8 / 17, 3))]


def test_classify(spark):
    rows = [(0, "body " * 30, 10, 0.0, 3), (1, "Big", 20, 0.0, 1), (2, "Table 1.1", 10, 0.0, 1), (3, "Bold head:", 10, 0.9, 1), (4, "Bold end.", 10, 0.9, 1), (5, " one\n• two\n•", 10, 0.0, 2), (6, "small\nnote", 8, 0.0, 1), (7, "Five lines", 20, 0.0, 5), (8, "Huge", 30, 0.0, 5)]
    blocks = spark.createDataFrame([(1, b, t, float(s), bold, n) for b, t, s, bold, n in rows], "doc_id int, block int, text string, size double, bold double, lines int")
    got = {r.block: (r.kind, r.level, r.text) for r in B.classify(blocks).collect()}
    assert got[1][:2] == ("heading", 1) and got[2][0] == "caption" and got[3] == ("heading", 2, "Bold head:") and got[4][0] == "para"
    assert got[5] == ("list", 0, "one\ntwo") and got[6] == ("note", 0, "small note") and got[7][:2] == ("heading", 1) and got[8][0] == "para"


def plain_split(text, weights):
    """Every space ranked by its distance to a share; the best one past the cut before."""
    places = [0]
    for k in range(1, len(weights)):
        goal = len(text) * sum(weights[:k]) / (sum(weights) or 1)
        ranked = sorted((abs(i - goal), i) for i, c in enumerate(text) if c == " ")
        places.append(next((i for _, i in ranked if i > places[-1] or k == 1), len(text)))
    return [text[a:z].strip() for a, z in itertools.pairwise([*places, len(text)])]


def test_split_by_weights(spark):
    rows = [(" ".join("x" * RANDOM.randint(1, 6) for _ in range(RANDOM.randint(0, 9))), [float(RANDOM.randint(0, 5)) for _ in range(RANDOM.randint(2, 5))]) for _ in range(60)]
    got = spark.createDataFrame(rows, "t string, w array<double>").select(R.split_by_weights(F.col("t"), F.col("w"))).collect()
    assert [r[0] for r in got] == [plain_split(t, w) for t, w in rows]
    assert spark.createDataFrame([("a b", [3.0])], "t string, w array<double>").select(R.split_by_weights(F.col("t"), F.col("w"))).first()[0] == ["a b"]


def test_placements(spark):
    part = "struct<page:int,x0:double,y0:double,x1:double,y1:double,size:double,color:int,bold:boolean,nchars:int>"
    two = [(1, 0.0, 0.0, 9.0, 9.0, 10.0, 0, False, 10), (2, 0.0, 0.0, 9.0, 9.0, 10.0, 0, False, 10)]
    rows = [(0, "heading", "a", "x y", two), (1, "list", "a\nb", "x\ny", two), (2, "para", "same", " same ", two), (3, "para", "s", "", two), (4, "figure", "", "f", two), (5, "para", "s", "d", [])]
    got = R.placements(spark.createDataFrame([(1, *r) for r in rows], f"doc_id int, block int, kind string, text string, dst string, parts array<{part}>")).orderBy("block", "piece").collect()
    assert [(r.block, r.page, r.text, r.bold) for r in got] == [(0, 1, "x", True), (0, 2, "y", True), (1, 1, "• x\n• y", False)]


def test_outline(spark):
    toc = [(0, 1, "A", 1), (1, 3, "deep", 2), (2, 2, "B", 2), (3, 3, "C", 4), (4, 1, "off", 3)]
    rows = spark.createDataFrame([(1, *t) for t in toc] + [(2, 0, 2, "X", 1)], "doc_id int, pos int, level int, title string, start int")
    pages = spark.createDataFrame([(1, 1), (1, 2), (1, 4), (2, 1)], "doc_id int, page int")
    assert [(r.title, r.level, r.page) for r in R.outline_of(rows, pages).orderBy("pos").collect()] == [("A", 1, 1), ("B", 2, 2), ("C", 3, 3)]
    assert [r.page for r in R.outline_of(rows, pages, interleave=True).orderBy("pos").collect()] == [2, 4, 6]


def keeper(spark, folder):
    def keep(df, name):
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    return keep


def segments(spark, rows):
    return spark.createDataFrame([(i, k, t, "", "") for i, (k, t) in enumerate(rows)], "id int, kind string, text string, section string, previous string")


def test_translation(spark, tmp_path):
    rows = [("para", "one 5"), ("para", "one 5"), ("list", "two\nthree"), ("heading", "Figure 3  x"), ("para", "cached")]
    parts = segments(spark, rows)
    cache = X.prompts(parts.where("id = 4"), "m").select("key", F.lit("đã có").alias("dst"))
    done, fresh = X.translate(parts, cache, X.stub, "m", keeper(spark, tmp_path))
    got = {r.id: (r.dst, r.cached) for r in done.collect()}
    assert got == {0: ("từ 5", False), 1: ("từ 5", False), 2: ("từ\ntừ", False), 3: ("từ 3 từ", False), 4: ("đã có", True)}
    assert fresh.count() == 3 and X.with_upserts(cache, fresh).count() == 4
    again, more = X.translate(parts, X.with_upserts(cache, fresh), X.stub, "m", keeper(spark, f"{tmp_path}/2"))
    assert more.count() == 0 and all(r.cached for r in again.collect())


def test_retry_and_lists(spark, tmp_path):
    """A severe flag asks once more, the better answer stays; a list of too few lines goes item by item."""

    def model(system, user, heat):
        source = user.split("<SOURCE>\n", 1)[1].rsplit("\n</SOURCE>", 1)[0]
        if "\n" in source:
            return "một dòng"
        if source == "worse":
            return source if heat < 0.5 else "5 the of and"
        return source if heat < 0.5 and source.startswith("hard") else f"dịch {source[-1]}"

    done, _ = X.translate(segments(spark, [("para", "hard a"), ("list", "xa\nxb"), ("para", "worse")]), spark.createDataFrame([], "key string, dst string"), model, "m", keeper(spark, tmp_path))
    assert {r.id: r.dst for r in done.collect()} == {0: "dịch a", 1: "dịch a\ndịch b", 2: "worse"}


def test_persistent_model():
    def play(*turns):
        waits, left = [], list(turns)

        def model(system, user, heat):
            turn = left.pop(0)
            if isinstance(turn, Exception):
                raise turn
            return turn

        try:
            return X.persistent(model, pause=waits.append)("", "", 0.2), waits
        except X.ModelError as e:
            return str(e), waits

    assert play("a") == ("a", []) and play("", TimeoutError(), "b") == ("b", [2, 4])
    assert play(X.Busy("b"), X.Busy("b"), "c") == ("c", [10, 20]) and play(X.ModelError("401")) == ("401", [])
    assert play(ConnectionRefusedError("no")) == ("no", []) and play("", "", "")[0] == "empty answer"


def test_exchange(spark, tmp_path):
    (tmp_path / "translations_1.jsonl").write_text('{"id": 1, "dst": "old"}\n{broken\n\n{"id": "2", "dst": "Table 5"}\n[1]\n{"dst": "x"}\n')
    (tmp_path / "translations_2.jsonl").write_text('{"id": 1, "dst": "new"}\n{"id": "y", "dst": "z"}\n')
    told = exchange.translations(exchange.lines(spark, f"{tmp_path}/translations*.jsonl"))
    assert {r.id: r.dst for r in told.collect()} == {1: "new", 2: "Table 5"}
    parts = spark.createDataFrame([(1, i, "para", f"s{i}") for i in (1, 2, 3)], "doc_id int, id bigint, kind string, text string")
    done = X.with_agent(parts, told.withColumn("doc_id", F.lit(1)))
    got = {r.id: (r.dst, r.flags) for r in done.collect()}
    assert got[1][0] == "new" and got[2][0] == "Bảng 5" and got[3] == ("", [X.AGENT_MISSING])
    assert X.counters(done).first()[1:] == (3, 2, 0, 3, 1)
    (tmp_path / "figure_texts.jsonl").write_text('{"figure": "fig-0003", "items": [{"en": "a", "vi": "b"}]}\n{"figure": "fig-0003", "items": [{"en": " c ", "vi": null}, null, {"vi": "z"}]}\n{"figure": "fig-0004", "items": []}\n{"figure": "x"}\n')
    texts = exchange.figure_texts(exchange.lines(spark, f"{tmp_path}/figure_texts*.jsonl"))
    assert sorted((r.figure, r.pos, r.en, r.vi) for r in texts.collect()) == [(3, 0, "c", ""), (4, None, None, None)]
    tasks = R.task_records(spark.createDataFrame([(1, i, "para", 1, "", "p" * 400, f"t{i}") for i in range(5)], "doc_id int, id int, kind string, page int, section string, previous string, text string"), 2)
    exchange.write_tasks(tasks, str(tmp_path / "tasks"))
    lines = [json.loads(x) for p in sorted((tmp_path / "tasks").rglob("part=1/*.txt")) for x in p.read_text().splitlines()]
    assert [x["id"] for x in lines] == [3, 4] and len(lines[0]["previous"]) == 300
    assert exchange.free_name(spark, str(tmp_path), "book").endswith("/book")
    (tmp_path / "book.vi.md").write_text("")
    assert exchange.free_name(spark, str(tmp_path), "book").endswith("/book (2)")
    exchange.save_state(str(tmp_path / "state"), blocks=parts)
    assert exchange.load_state(spark, str(tmp_path / "state"), "blocks")[0].count() == 3


def test_streams(spark, tmp_path):
    """Batches go out in order; one that needs nothing goes with the one before; what is left is flushed."""
    needs = spark.createDataFrame([(1, 0, 1), (1, 0, 2), (1, 1, None), (1, 2, 3), (1, 3, 4)], "doc_id long, batch int, id int")
    for n, ids in enumerate([[3, 2], [1, 2], [9]]):
        spark.createDataFrame([(1, i) for i in ids], "doc_id long, id int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/done")
    done = spark.readStream.schema("doc_id long, id int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/done")
    query = S.release_stream(done, needs).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    released = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r.batch, r.segments) for r in released.collect()) == [(0, 2), (1, 0), (2, 1)]
    assert [(r.batch, r.segments) for r in S.flushed(needs, released).collect()] == [(3, 1)]
    (tmp_path / "in").mkdir()
    for name, text in (("translations_1.jsonl", '{"id": 1, "dst": "a"}\n{x\n'), ("translations_2.jsonl", '{"id": "1", "dst": "b"}\n')):
        (tmp_path / "in" / name).write_text(text)
        S.collect_translations(S.translation_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/table", f"{tmp_path}/log2").awaitTermination()
    assert [(r.id, r.dst) for r in S.latest_translations(spark, f"{tmp_path}/table").collect()] == [(1, "b")]


def test_slugs(spark):
    rows = [("Điều trị Nội nha!",), ("!!!",), ("x" * 70,), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, "t string").select(T.slug(F.col("t"))).collect()][:3] == ["dieu-tri-noi-nha", "tai-lieu", "x" * 60]


def plain_extract(raws, media, body, sizes, repeated):
    """One document by the rules, a page after the other; raws and media are dicts."""
    inside = lambda a, b: max(0, min(a["x1"], b["x1"]) - max(a["x0"], b["x0"])) * max(0, min(a["y1"], b["y1"]) - max(a["y0"], b["y0"]))
    out = []
    for page in sorted({r["page"] for r in [*raws, *media]}):
        here = [r for r in raws if r["page"] == page]
        wide = sorted((r["y0"], r["block"]) for r in here if r["width"] > 330 or r["x0"] < 290 and r["x1"] > 310)
        across = {block for _, block in wide}
        columns = any(r["x0"] >= 300 for r in here if r["block"] not in across)

        def spot(r):
            if not columns:
                return r["y0"], r["x0"], r["block"]
            if r["block"] in across:
                return wide.index((r["y0"], r["block"])), 1, 0, r["y0"], r["block"]
            return sum(y <= r["y0"] for y, _ in wide), 0, r["x0"] >= 300, r["y0"], r["block"]

        ordered = sorted(here, key=spot)
        texts = []
        for r in ordered:
            edge = r["y0"] < 64 or r["y1"] > 736
            if edge and r["size"] < 1.15 * body and r["text"].lower().replace("7", "#") in repeated:
                continue
            kind = "heading" if r["size"] in sizes else "note" if r["size"] < 0.85 * body else "para"
            if any(m["kind"] == "figure" and inside(r, m) > 0.8 * (r["x1"] - r["x0"]) * (r["y1"] - r["y0"]) for m in media if m["page"] == page):
                kind = "label"
            texts.append((kind, r["text"], r["y0"]))
        left = sorted((m for m in media if m["page"] == page), key=lambda m: (m["y0"], m["block"]))
        for t in texts:
            while left and left[0]["y0"] <= t[2]:
                out.append((left.pop(0)["kind"], "", page))
            out.append((t[0], t[1], page))
        out += [(m["kind"], "", page) for m in left]
    merged, last = [], None
    for kind, text, page in out:
        if kind == "para" and last is not None and not merged[last][1].endswith(".") and text[0].islower():
            merged[last] = ("para", merged[last][1] + " " + text, merged[last][2])
            continue
        merged.append((kind, text, page))
        if kind not in ("figure", "label"):
            last = len(merged) - 1 if kind == "para" else None
    return merged


def test_extraction(spark):
    raws, media = [], []
    for doc in range(12):
        for k in range(RANDOM.randint(4, 25)):
            x0, wide = RANDOM.choice((40, 40, 310)), RANDOM.random() < 0.15
            y0, width, lines = RANDOM.choice((30, 100, 200, 210, 400, 600, 700)), 500 if wide else 230, RANDOM.randint(1, 3)
            text = RANDOM.choice(("Header 7", "words that go on", "Words that end.", "more words", "Other words"))
            raws.append({"doc_id": doc, "book": 1, "page": RANDOM.randint(1, 3), "block": k, "text": text, "x0": 40 if wide else x0, "y0": y0, "x1": (40 if wide else x0) + width, "y1": y0 + 12 * lines, "width": width, "size": RANDOM.choice((10, 10, 10, 8, 14)), "bold": 0.0, "lines": lines})
        for k in range(RANDOM.randint(0, 3)):
            y0 = RANDOM.choice((90, 200, 390))
            media.append({"doc_id": doc, "page": RANDOM.randint(1, 3), "block": 100 + k, "kind": RANDOM.choice(("figure", "table")), "text": "", "x0": 30, "y0": y0, "x1": 290, "y1": y0 + 60})
    frame = spark.createDataFrame([tuple(r.values()) for r in raws], "doc_id int, book int, page int, block int, text string, x0 int, y0 int, x1 int, y1 int, width int, size int, bold double, lines int")
    pictures = spark.createDataFrame([tuple(m.values()) for m in media], "doc_id int, page int, block int, kind string, text string, x0 int, y0 int, x1 int, y1 int")
    got = A.extracted_blocks(frame, pictures, spark.createDataFrame([(1, "header #")], "book int, line string")).orderBy("doc_id", "block").collect()
    for doc in range(12):
        own = [r for r in raws if r["doc_id"] == doc]
        weights = {}
        for r in own:
            weights[r["size"]] = weights.get(r["size"], 0) + len(r["text"])
        # of equal weights the size met first in reading order wins, so such documents are told by the operator's own choice
        body = [s for s in weights if weights[s] == max(weights.values())]
        want = [plain_extract(own, [m for m in media if m["doc_id"] == doc], b, {s for s in weights if s >= 1.15 * b}, {"header #"}) for b in body]
        assert [(r.kind, r.text, r.page) for r in got if r.doc_id == doc] in want
