"""Values on forms: next to labels, under headings of check boxes, and in machine-readable zones.

Blocks and marks of a page are gathered once (a page is small) and meet there, by the geometry; labels are a registry
table. Nothing that grows with the documents is broadcast. Rectangles are x0, y0, x1, y1 in the page's unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.functions import validators as V
from quillmark.tables import registry_side

# fixed values: what a binding is worth, and how far it reaches in shares of the page
SAME_LINE, RIGHT, BELOW, NEXT_LINE, DECAY, LABEL_CAP = 0.82, 0.76, 0.70, 0.62, 0.35, 0.95
LABEL_X, LABEL_Y = 0.55, 0.06
OPTION, GROUP, SEVERAL = 0.86, 0.82, 0.8
OPTION_X, OPTION_Y, GROUP_X, GROUP_Y = 0.22, 0.03, 0.60, 0.14
CUT, TIGHTENED = 0.85, 0.90
VERIFIED_ZONE, READ_ZONE = 0.97, 0.55
LEAST_LABEL, VERBATIM = 88.0, 96.0
# fixed values: words that join the parts of a phrase, in English, Spanish, Portuguese and French
CONNECTORS = "a an and or of the to in on for by with at from as de del la el los las un una y e o en por con para do da dos das le les des du et ou au aux".split()
# fixed values: what a printed answer to a yes-or-no field may be
YES, NO = ("true", "yes", "y", "checked", "x", "f", "compliant"), ("false", "no", "n", "unchecked", "not checked", "none")
# fixed values: what a value of a type looks like
TYPE_SHAPE = {"date": r"[0-9]{1,4}[-/. ][0-9A-Za-z]{1,12}[-/., ]+[0-9]{1,4}|\p{L}{3,}\.? [0-9]{1,2},? [0-9]{4}", "number": r"-?[(]?[$€£]?\s?[0-9][0-9.,' ]*[)-]?", "id": r"[A-Z0-9][A-Z0-9 ./<-]*[A-Z0-9<]"}
MULTILINE = ("address",)


def label_key(text: Column) -> Column:
    """A label's normal form: folded, punctuation as blanks."""
    return F.trim(F.regexp_replace(T.fold(text), r"[^\p{L}\p{N}]+", " "))


def let(x: Column, f) -> Column:
    """f of x, which is evaluated once however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def side(rect: str | Column, k: str) -> Column:
    """x0, y0, x1 or y1 of a rectangle: a struct, or the prefix of four columns."""
    return F.col(f"{rect}_{k}") if isinstance(rect, str) else rect[k]


def share(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    """Overlap of two stretches as a share of the shorter one."""
    both = F.greatest(F.lit(0.0), F.least(high_a, high_b) - F.greatest(low_a, low_b))
    return F.least(F.lit(1.0), both / F.greatest(F.least(high_a - low_a, high_b - low_b), F.lit(1e-9)))


def right_of(a: str | Column, b: str | Column, reach: Column, least: float = 0.3) -> tuple[Column, Column]:
    """(whether rectangle b stands right of a on its line, the gap)."""
    gap = side(b, "x0") - side(a, "x1")
    return (gap >= -0.25 * (side(a, "x1") - side(a, "x0"))) & (gap <= reach) & (share(side(a, "y0"), side(a, "y1"), side(b, "y0"), side(b, "y1")) >= least), F.greatest(gap, F.lit(0.0))


def below(a: str | Column, b: str | Column, reach: Column, least: float = 0.15) -> tuple[Column, Column]:
    gap = side(b, "y0") - side(a, "y1")
    return (gap >= -0.25 * (side(a, "y1") - side(a, "y0"))) & (gap <= reach) & (share(side(a, "x0"), side(a, "x1"), side(b, "x0"), side(b, "x1")) >= least), F.greatest(gap, F.lit(0.0))


def page_sizes(pages: DataFrame) -> DataFrame:
    """(doc_id, page, width, height), each page once. As many rows as documents have pages: never a side to broadcast."""
    return pages.groupBy("doc_id", "page").agg(F.max(F.struct("width", "height")).alias("_p")).select("doc_id", "page", "_p.width", "_p.height").hint("merge")


def named(df: DataFrame, prefix: str, *more: str) -> DataFrame:
    return df.select("doc_id", "page", *[F.col(c).alias(f"{prefix}_{c}") for c in ("x0", "y0", "x1", "y1", *more)])


def union_rect(*prefixes: str) -> Column:
    return F.struct(*[f(*[F.col(f"{p}_{c}") for p in prefixes]).alias(c) for c, f in (("x0", F.least), ("y0", F.least), ("x1", F.greatest), ("y1", F.greatest))])


def captions_cut(value: Column, captions: list[str]) -> Column:
    """The value up to the next caption of the form that a colon closes, or that stands after a wide gap."""
    if not captions:
        return value
    # long captions first, so that the whole of one is cut
    names = "|".join(sorted(("\\Q" + c + "\\E" for c in captions), key=len, reverse=True))
    return F.regexp_replace(value, rf"(?ius)(?:^|[\s,;|/]+)(?:{names})\s*[:：].*$", "")


def tightened(value: Column, kind: Column) -> Column:
    """The part of a value that has its type's shape, where the type has one."""
    out = value
    for k, p in TYPE_SHAPE.items():
        hit = F.regexp_extract(value, rf"(?:^|(?<=[\s:(]))(?:{p})(?=$|[\s,;.)])", 0)
        out = F.when((kind == k) & (hit != ""), F.trim(hit)).otherwise(out)
    return out


def has_shape(value: Column, kind: Column) -> Column:
    """False for a value that its type rules out; types without a shape take any."""
    out = F.lit(True)
    for k, p in TYPE_SHAPE.items():
        out = F.when(kind == k, value.rlike(rf"^(?:{p})$") & (value.rlike("[0-9]") if k != "id" else value.rlike("[0-9A-Z]"))).otherwise(out)
    return F.when(kind == "bool", as_bool(value).isNotNull()).otherwise(out)


def as_bool(value: Column) -> Column:
    """'true', 'false', or null for text that is neither."""
    v = F.regexp_replace(F.lower(F.trim(value)), r"^[.:;]+|[.:;]+$", "")
    return F.when(v.isin(*YES), "true").when(v.isin(*NO), "false")


def ends_open(value: Column) -> Column:
    """Whether a text breaks off at a word that joins phrases."""
    return F.lower(F.regexp_extract(value, r"(?U)([^\W\d_][\w'’-]*)[\s.]*$", 1)).isin(*CONNECTORS)


def reads_as_caption(text: Column, captions: list[str]) -> Column:
    """Whether a text is a caption of the form: one of its labels, or closed by a colon."""
    return label_key(text).isin(*[c for c in captions]) | F.coalesce(F.trim(text).rlike(r"[:：]$"), F.lit(False))


def trimmed(value: Column, kind: Column, pattern: Column, confidence: Column, captions: list[str]) -> Column:
    """struct(value, confidence): the trimmed value and what trimming leaves of its confidence; null if what is left is no value."""

    def judged(v: Column, c: Column, t: Column) -> Column:
        trust = F.round(F.least(F.lit(LABEL_CAP), confidence * F.when(c != v, CUT).otherwise(1.0) * F.when(t != c, TIGHTENED).otherwise(1.0)), 4)
        ok = (t != "") & T.has_substance(t) & ~reads_as_caption(t, captions) & has_shape(t, kind) & ~ends_open(t)
        fits = F.when(pattern.isNull(), F.lit(True)).otherwise(F.regexp(t, F.concat(F.lit("^(?:"), pattern, F.lit(")$"))))
        return F.when(ok & fits, F.struct(t.alias("value"), trust.alias("confidence")))

    return let(T.clean_value(value), lambda v: let(T.clean_value(captions_cut(v, captions)), lambda c: let(tightened(c, kind), lambda t: judged(v, c, t))))


def line_value(caption: Column) -> Column:
    """What follows a block's label on its line (columns text and label), if the line uses it as a caption; else null."""

    def rest(before: Column, after: Column) -> Column:
        closed = after.rlike(r"^[\s.\-–—]*[:：]")
        opens = before.rlike(r"^\s*(?:[(\[]?[0-9ivxIVX]{1,4}[).\]]?|[-•▪*–—])?\s*$")
        first = F.lower(F.regexp_extract(after, r"(?U)^[ \t]*([^\W\d_][\w'’-]*)", 1))
        last = F.lower(F.regexp_extract(before, r"(?U)([^\W\d_][\w'’-]*)\s*$", 1))
        running = ~closed & (after.rlike(r"^\s*[,;]") | first.isin(*CONNECTORS) | last.isin(*CONNECTORS))
        used = (~caption | closed) & (closed | after.rlike(r"^(?:\t|  )") | (after == "") | opens) & ~running
        return F.when(used, F.regexp_replace(F.regexp_replace(after, r"^[\s:.\-–—]*[(\[][^)\]]*[)\]]", ""), r"^[\s:：.\-–—]+", ""))

    at = F.expr("locate(lower(label), lower(text))")
    before, after = F.expr("substring(text, 1, locate(lower(label), lower(text)) - 1)"), F.expr("substring(text, locate(lower(label), lower(text)) + length(label))")
    return F.when(at > 0, let(before, lambda x: let(after, lambda y: rest(x, y))))


def label_candidates(blocks: DataFrame, pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, name, value, confidence, how, page, seq): values bound to labels.

    blocks: (doc_id, seq, page, text, zone, x0..y1, nulls without geometry); pages: (doc_id, page, width, height); labels, a
    registry table: (name, label, type, pattern, weight). A label that a block carries binds what follows it on the
    line, if the line uses it as a caption: it opens the line, or a colon or a wide gap closes it, and no joining word
    goes on with its phrase. Else a block that is the label binds the nearest block right of it and the nearest below (for
    addresses with the lines under that one), and without geometry the next line, for verbatim labels of values with a
    shape. Other captions are never values.

    Blocks meet the labels where they stand, and are then gathered by page, in one shuffle; all else happens inside a page."""
    listed = [r.k for r in labels.select(label_key(F.col("label")).alias("k")).distinct().collect()]  # a registry's labels
    spoken = [r.label for r in labels.select("label").distinct().collect()]
    framed = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    lab = labels.select("name", "type", "pattern", F.coalesce("weight", F.lit(1.0)).alias("weight"), F.trim("label").alias("label"), label_key(F.col("label")).alias("_l")).withColumn("_lf", framed(F.col("_l")))
    b = blocks.where(F.trim("text") != "").select("doc_id", "page", "seq", "text", "zone", "x0", "y0", "x1", "y1", framed(label_key(F.col("text"))).alias("_kf"), reads_as_caption(F.col("text"), listed).alias("_caption"))
    s = F.when(F.col("_kf") == F.col("_lf"), 100.0).otherwise(VERBATIM) * F.col("weight")
    met = b.join(registry_side(lab), F.col("_kf").contains(F.col("_lf")) & (s >= LEAST_LABEL), "left").withColumn("_s", s)
    on_line = trimmed(line_value(F.col("_caption")), F.col("type"), F.col("pattern"), SAME_LINE * F.col("_s") / 100, spoken)
    # a block stands here once for each label that it carries, or once
    entry = F.struct("seq", "text", "zone", "x0", "y0", "x1", "y1", "_caption", "name", "type", "pattern", "weight", "_l", "_s", F.when(F.col("name").isNotNull(), on_line).alias("_line"))
    page = met.groupBy("doc_id", "page").agg(F.collect_list(entry).alias("_all")).join(page_sizes(pages), ["doc_id", "page"], "left")
    x, y = LABEL_X * F.col("width"), LABEL_Y * F.col("height")

    def found(h: Column, value: Column, confidence: Column, how: str) -> Column:
        return F.struct(h["seq"].alias("seq"), h["name"].alias("name"), h["type"].alias("type"), h["pattern"].alias("pattern"), value.alias("value"), confidence.alias("confidence"), F.lit(how).alias("how"))

    def nearest(h: Column, values: Column, beside, reach: Column) -> Column:
        """The value with the smallest gap."""
        near = F.filter(values, lambda v: (v["seq"] != h["seq"]) & beside(h, v, reach)[0])
        return F.array_min(F.transform(near, lambda v: F.struct(beside(h, v, reach)[1].alias("gap"), *[v[c].alias(c) for c in ("seq", "text", "x0", "y0", "x1", "y1")])))

    def bound(h: Column, v: Column, reach: Column, base: float, how: str, value: Column) -> Column:
        trust = base * h["_s"] / 100 * (1 - DECAY * F.least(F.lit(1.0), v["gap"] / F.greatest(reach, F.lit(1e-9))))
        return F.when(v.isNotNull(), found(h, value, trust, how))

    def lines(v: Column, values: Column) -> Column:
        """A block's text and the lines right under it, up to a gap."""
        under = F.filter(values, lambda c: (c["y0"] >= v["y1"] - 0.25 * (v["y1"] - v["y0"])) & (share(v["x0"], v["x1"], c["x0"], c["x1"]) >= 0.15))
        rows = F.array_sort(F.transform(under, lambda c: F.struct(c["y0"].alias("y0"), c["seq"].alias("seq"), c["text"].alias("text"), c["y1"].alias("y1"))))

        def joined(r: Column) -> Column:
            breaks = F.transform(r, lambda c, k: c["y0"] - F.when(k > 0, F.get(r, k - 1)["y1"]).otherwise(v["y1"]) > 0.5 * y)
            first = F.coalesce(F.array_position(breaks, F.lit(True)), F.lit(0)).cast("int")
            kept = F.slice(r, F.lit(1), F.when(first > 0, first - 1).otherwise(F.size(r)))
            return F.array_join(F.concat(F.array(v["text"]), F.transform(kept, lambda c: c["text"])), "\n")

        return let(rows, joined)

    def next_line(h: Column) -> Column:
        """The next block of a page that nobody measured, in reading order."""
        after = F.array_min(F.transform(F.filter("_all", lambda v: v["seq"] > h["seq"]), lambda v: F.struct(v["seq"].alias("seq"), v["text"].alias("text"), v["_caption"].alias("_caption"), v["zone"].alias("zone"))))
        plain = lambda n: ~n["_caption"] & (n["zone"] != "furniture") & ~n["text"].rlike(r"^\s*[(\[]?[0-9ivxIVX]{1,4}[).\]]?\s*$")
        return let(after, lambda n: F.when(plain(n), found(h, n["text"], NEXT_LINE * h["_s"] / 100, "next line")))

    def beside(h: Column, values: Column) -> Column:
        right = let(nearest(h, values, right_of, x), lambda v: bound(h, v, x, RIGHT, "right", v["text"]))
        under = let(nearest(h, values, below, y), lambda v: bound(h, v, y, BELOW, "below", F.when(h["type"].isin(*MULTILINE), lines(v, values)).otherwise(v["text"])))
        verbatim = h["_caption"] & (h["_s"] >= VERBATIM * h["weight"]) & h["type"].isin(*TYPE_SHAPE)
        return F.when(h["x0"].isNotNull(), F.array(right, under)).when(verbatim, F.array(next_line(h)))

    def lone(h: Column, hits: Column) -> Column:
        """Whether a block's line binds nothing to a field, and this is the best of the field's labels that it carries."""
        rank = lambda g: F.struct((-g["_s"]).alias("s"), g["_l"].alias("l"), g["type"].alias("t"), g["pattern"].alias("p"))
        return ~F.exists(hits, lambda g: (g["seq"] == h["seq"]) & (g["name"] == h["name"]) & (g["_line"].isNotNull() | (rank(g) < rank(h))))

    def places(hits: Column) -> Column:
        own = F.transform(F.filter(hits, lambda h: h["_line"].isNotNull()), lambda h: F.struct(h.alias("h"), found(h, h["_line"]["value"], h["_line"]["confidence"], "same line").alias("c")))
        values = F.array_distinct(F.transform(F.filter("_all", lambda v: ~v["_caption"] & v["x0"].isNotNull()), lambda v: F.struct(*[v[c].alias(c) for c in ("seq", "text", "x0", "y0", "x1", "y1")])))
        rest = let(values, lambda vs: F.flatten(F.transform(F.array_distinct(F.filter(hits, lambda h: lone(h, hits))), lambda h: F.coalesce(F.filter(beside(h, vs), lambda c: c.isNotNull()), F.array()))))
        return F.concat(F.transform(own, lambda o: o["c"]), rest)

    c = page.select("doc_id", "page", F.explode(let(F.filter("_all", lambda v: v["name"].isNotNull()), places)).alias("c")).select("doc_id", "page", "c.*")
    kept = F.when(F.col("how") == "same line", F.struct("value", "confidence")).otherwise(trimmed(F.col("value"), F.col("type"), F.col("pattern"), F.col("confidence"), spoken))
    out = c.select("doc_id", "name", F.explode(F.filter(F.array(kept), lambda v: v.isNotNull())).alias("v"), "how", "page", "seq")
    return out.select("doc_id", "name", "v.value", "v.confidence", "how", "page", "seq")


def bound_marks(marks: DataFrame, blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """marks (doc_id, mark, page, selected, x0..y1) with option: the text right of the mark, else left of it, else below."""
    rect = ("x0", "y0", "x1", "y1")
    near = blocks.where(F.trim("text") != "").groupBy("doc_id", "page").agg(F.collect_list(F.struct("seq", "text", *rect)).alias("_blocks")).join(page_sizes(pages), ["doc_id", "page"])
    x, y = OPTION_X * F.col("width"), OPTION_Y * F.col("height")

    def cost(m: Column, b: Column) -> Column:
        (after, g1), (left, g2), (under, g3) = right_of(m, b, x, 0.25), right_of(b, m, x, 0.25), below(m, b, y, 0.3)
        return F.when(after, g1).when(left, g2 + 0.5 * x).when(under, g3 + x)

    reached = lambda m: F.filter(F.transform("_blocks", lambda b: F.struct(cost(m, b).alias("c"), b["seq"].alias("seq"), b["text"].alias("text"))), lambda r: r["c"].isNotNull())
    best = F.array_min(let(F.struct(*rect), reached))["text"]
    j = marks.join(near.hint("merge"), ["doc_id", "page"], "left").withColumn("option", T.clean_value(F.coalesce(best, F.lit(""))))
    return j.select(*marks.columns, "option")


def mark_candidates(marks: DataFrame, blocks: DataFrame, pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, name, value, confidence, mark): check boxes whose option is a field's label, and the selected options near a
    heading that is one; several selected options share the blame."""
    lab = registry_side(labels.select("name", "type", label_key(F.col("label")).alias("_l")))
    m = bound_marks(marks, blocks, pages)
    own = m.where("option != ''").withColumn("_l", label_key(F.col("option"))).join(lab, "_l").where((F.col("type") == "bool") | F.col("selected"))
    own = own.select("doc_id", "name", F.when(F.col("type") == "bool", F.col("selected").cast("string")).otherwise(F.col("option")).alias("value"), F.lit(OPTION).alias("confidence"), "mark")
    heads = blocks.where("x0 is not null").withColumn("_l", label_key(F.col("text"))).join(lab, "_l")
    j = named(heads, "h", "name", "type", "seq").join(named(m.where("selected and option != ''"), "m", "mark", "option").hint("merge"), ["doc_id", "page"]).join(page_sizes(pages), ["doc_id", "page"])
    under, _ = below("h", "m", GROUP_Y * F.col("height"), 0.0)
    beside, _ = right_of("h", "m", GROUP_X * F.col("width"), 0.2)
    g = j.where(under | beside).withColumn("_n", F.count("*").over(Window.partitionBy("doc_id", "page", "h_seq", "h_name")))
    g = g.select("doc_id", F.col("h_name").alias("name"), F.when(F.col("h_type") == "bool", "true").otherwise(F.col("m_option")).alias("value"), F.round(GROUP * F.when(F.col("_n") == 1, 1.0).otherwise(SEVERAL), 4).alias("confidence"), F.col("m_mark").alias("mark"))
    return own.unionByName(g)


ZONE_SHAPES = (("TD1", 3, 30), ("TD3", 2, 44), ("TD2", 2, 36))


def zone_fields(blocks: DataFrame, as_of_year: int) -> DataFrame:
    """(doc_id, kind, name, value, verified, confidence): the fields of machine-readable zones in a document's blocks.

    Two-digit birth years after as_of_year's are of the last century, expiry years up to fifty ahead of this one. Zones
    whose check digits fail are read with less confidence."""
    lines = blocks.select("doc_id", "page", "seq", F.posexplode(V.mrz_lines(F.col("text"))).alias("k", "line")).where(F.col("line").rlike("^[A-Z0-9<]{30}$|^[A-Z0-9<]{36}$|^[A-Z0-9<]{44}$"))
    w = Window.partitionBy("doc_id", "page").orderBy("seq", "k")
    cut = lines.withColumn("l1", F.col("line")).withColumn("l2", F.lead("line", 1).over(w)).withColumn("l3", F.lead("line", 2).over(w))
    size, two, three = F.length("l1"), F.length("l2"), F.length("l3")
    kind = F.when((size == 30) & (two == 30) & (three == 30), "TD1").when((size == 44) & (two == 44), "TD3").when((size == 36) & (two == 36), "TD2")
    cut = cut.withColumn("kind", kind).withColumn("_at", F.row_number().over(w))
    # a zone's later lines begin no zone of their own
    cut = cut.withColumn("_last", F.max(F.when(F.col("kind") == "TD1", F.col("_at") + 2).when(F.col("kind").isNotNull(), F.col("_at") + 1)).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    z = cut.where(F.col("kind").isNotNull() & (F.coalesce("_last", F.lit(0)) < F.col("_at")) & F.col("l1").rlike("^[A-Z]"))
    part = lambda line, a, b: F.substring(line, a + 1, b - a)
    plain = lambda c: F.trim(F.regexp_replace(c, "<+", " "))
    td1, first = F.col("kind") == "TD1", F.col("kind") == "TD3"
    names = F.when(td1, F.col("l3")).otherwise(F.substring(F.col("l1"), 6, 39))
    given = F.when(names.contains("<<"), F.regexp_replace(names, "^.*?<<", "")).otherwise("")
    now = as_of_year % 100

    def dated(c: Column, born: bool) -> Column:
        yy = F.substring(c, 1, 2).cast("int")
        century = F.when(yy > now, 1900).otherwise(2000) if born else F.when(yy <= now + 50, 2000).otherwise(1900)
        return F.when(c.rlike("^[0-9]{6}$"), F.coalesce(V.real_date(yy + century, F.substring(c, 3, 2), F.substring(c, 5, 2)), c)).otherwise(c)

    sex = F.when(td1, part("l2", 7, 8)).otherwise(part("l2", 20, 21))
    made = {
        "document_code": plain(part("l1", 0, 2)), "issuing_state": plain(part("l1", 2, 5)), "surname": plain(F.regexp_replace(names, "<<.*$", "")), "given_names": plain(given),
        "document_number": plain(F.when(td1, part("l1", 5, 14)).otherwise(part("l2", 0, 9))), "nationality": plain(F.when(td1, part("l2", 15, 18)).otherwise(part("l2", 10, 13))),
        "date_of_birth": dated(F.when(td1, part("l2", 0, 6)).otherwise(part("l2", 13, 19)), True), "sex": F.when(sex.isin("M", "F", "X"), sex).otherwise(""),
        "expiry_date": dated(F.when(td1, part("l2", 8, 14)).otherwise(part("l2", 21, 27)), False), "personal_number": F.when(first, plain(part("l2", 28, 42))).otherwise(""),
        "optional_data": F.when(td1, plain(part("l1", 15, 30))).when(~first, plain(part("l2", 28, 35))).otherwise(""),
    }
    whole = F.when(td1, F.concat_ws("\n", "l1", "l2", "l3")).otherwise(F.concat_ws("\n", "l1", "l2"))
    z = z.withColumn("_whole", whole)
    for name in ("mrz_td1", "mrz_td2", "mrz_td3"):
        z = z.withColumn(f"_{name}", V.check(name, F.col("_whole")))
    ok = F.when(td1, F.col("_mrz_td1.ok")).when(first, F.col("_mrz_td3.ok")).otherwise(F.col("_mrz_td2.ok"))
    rows = z.select("doc_id", "kind", ok.alias("verified"), F.explode(F.create_map(*[x for k, v in made.items() for x in (F.lit(k), v)])).alias("name", "value")).where("value != ''")
    return rows.withColumn("confidence", F.when(F.col("verified"), VERIFIED_ZONE).otherwise(READ_ZONE))


def context(blocks: DataFrame, hits: DataFrame, around: int = 2) -> DataFrame:
    """The blocks within `around` places of a hit (doc_id, seq) on its page, each once, in reading order."""
    w = Window.partitionBy("doc_id", "page").orderBy("seq").rowsBetween(-around, around)
    marked = blocks.join(hits.select("doc_id", "seq", F.lit(1).alias("_h")).distinct(), ["doc_id", "seq"], "left")
    return marked.withColumn("_near", F.max("_h").over(w)).where("_near = 1").drop("_h", "_near")
