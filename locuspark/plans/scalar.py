"""Scalar kernels, filters and text formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from locuspark.functions import kernels as K
from locuspark.plans.base import DEPTH, IV, depth, iv, table
from locuspark.plans.registry import query
from locuspark.sources import sinks, text

_CIG = """c AS (SELECT l_orderkey AS id, l_linenumber AS ln, l_partkey AS p, (l_linenumber)::VARCHAR || 'S' || (l_quantity::INT)::VARCHAR || 'M' || (l_linenumber + 1)::VARCHAR || 'I' || ((l_partkey % 9) + 1)::VARCHAR || 'D' || (l_suppkey % 5 + 1)::VARCHAR || '=' || (l_suppkey % 3 + 1)::VARCHAR || 'X' AS cigar, l_quantity::BIGINT AS m, l_partkey % 9 + 1 AS d, l_suppkey % 5 + 1 AS e, l_suppkey % 3 + 1 AS x FROM lineitem)"""


def _cigars(s, d):
    t = lambda c: c.cast("string")
    q, p, u, n = F.col("l_quantity").cast("int"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    text_ = F.concat(t(n), F.lit("S"), t(q), F.lit("M"), t(n + 1), F.lit("I"), t(p % 9 + 1), F.lit("D"), t(u % 5 + 1), F.lit("="), t(u % 3 + 1), F.lit("X"))
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), n.alias("ln"), p.alias("p"), text_.alias("cigar"))


@query("H1_cigar", f"""WITH {_CIG} SELECT id, ln, p, cigar, m + d + e + x AS covered, 6::BIGINT AS ops FROM c""")
def h1(s, d):
    return _cigars(s, d).select("id", "ln", "p", "cigar", K.reference_length(F.col("cigar")).alias("covered"), F.size(K.cigar_ops(F.col("cigar"))).cast("long").alias("ops"))


@query("D28_cigar_tallies", f"""WITH {_CIG} SELECT id, ln, p, x AS mismatches, e AS matches, 1::BIGINT AS deletions, 1::BIGINT AS insertions, ln::BIGINT AS clipped, round(e / (e + x), 6) AS identity FROM c""")
def d28(s, d):
    c = F.col("cigar")
    x, e = K.cigar_sum(c, "X"), K.cigar_sum(c, "=")
    return _cigars(s, d).select("id", "ln", "p", x.alias("mismatches"), e.alias("matches"), K.cigar_events(c, "D").alias("deletions"), K.cigar_events(c, "I").alias("insertions"), K.cigar_sum(c, "SH").alias("clipped"), F.round(e / (e + x), 6).alias("identity"))


@query("H2_projected_read", """WITH r AS (SELECT l_orderkey AS id, l_linenumber AS ln, l_partkey AS p, repeat('ACGTTGCA', 4) AS seq, (l_suppkey % 4 + 1)::INT AS a, (l_partkey % 5 + 1)::INT AS b, l_linenumber AS i, (l_quantity::INT % 3) + 1 AS g FROM lineitem)
  SELECT id, ln, p, substr(seq, a + 1, b) || repeat('-', g) || substr(seq, a + b + i + 1, 6) AS laid FROM r""")
def h2(s, d):
    a, b, i, g = (F.col("l_suppkey") % 4 + 1), (F.col("l_partkey") % 5 + 1), F.col("l_linenumber"), (F.col("l_quantity").cast("int") % 3 + 1)
    t = lambda c: c.cast("string")
    cigar = F.concat(t(a), F.lit("S"), t(b), F.lit("M"), t(i), F.lit("I"), t(g), F.lit("D6M"))
    r = table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), i.alias("ln"), F.col("l_partkey").alias("p"), F.repeat(F.lit("ACGTTGCA"), F.lit(4)).alias("seq"), cigar.alias("cigar"))
    return r.select("id", "ln", "p", K.project_read(F.col("seq"), F.col("cigar")).alias("laid"))


@query("H3_reverse_complement", """SELECT doc_id, reverse(translate(upper(regexp_replace(text, '[^ -~]', '', 'g')), 'ACGTU', 'TGCAA')) AS rc FROM documents""")
def h3(s, d):
    return table(s, d, "documents").select("doc_id", K.reverse_complement(F.regexp_replace("text", "[^ -~]", "")).alias("rc"))


@query("H4_subsequence", """SELECT doc_id, substr(text, 5, 16) AS part FROM documents""")
def h4(s, d):
    return table(s, d, "documents").select("doc_id", K.subsequence(F.col("text"), F.lit(5), F.lit(20)).alias("part"))


@query("H5_length", """SELECT doc_id, length(text) AS n FROM documents""")
def h5(s, d):
    return table(s, d, "documents").select("doc_id", F.length("text").cast("long").alias("n"))


@query("H6_select_by_name", """SELECT p_name, p_partkey FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size = 7)""")
def h6(s, d):
    p = table(s, d, "part")
    return p.select("p_name", "p_partkey", "p_brand").join(p.where("p_size = 7").select("p_brand"), "p_brand", "left_semi").select("p_name", "p_partkey")


_GT = """g AS (SELECT l_orderkey AS id, l_linenumber AS ln, l_partkey AS p, CASE WHEN l_quantity < 5 THEN '.' ELSE (l_suppkey % 2)::VARCHAR END || CASE WHEN l_tax < 0.04 THEN '|' ELSE '/' END || CASE WHEN l_quantity < 5 THEN '.' ELSE (l_partkey % 2)::VARCHAR END AS gt FROM lineitem)"""


def _gts(s, d):
    low = F.col("l_quantity") < 5
    one, two = F.when(low, ".").otherwise((F.col("l_suppkey") % 2).cast("string")), F.when(low, ".").otherwise((F.col("l_partkey") % 2).cast("string"))
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("p"), F.concat(one, F.when(F.col("l_tax") < 0.04, "|").otherwise("/"), two).alias("gt"))


@query("H7_genotype_tests", f"""WITH {_GT} SELECT id, ln, p, replace(gt, '|', '/') AS gt, replace(gt, '|', '/') IN ('0/1', '1/0') AS het, replace(gt, '|', '/') = './.' AS missing FROM g""")
def h7(s, d):
    g = F.col("gt")
    return _gts(s, d).select("id", "ln", "p", K.normal_genotype(g).alias("gt"), K.is_het(g).alias("het"), K.is_missing(g).alias("missing"))


@query("H8_genotype_bases", f"""WITH {_GT} SELECT id, ln, p, array_to_string(list_transform(string_split(replace(gt, '|', '/'), '/'), lambda x: CASE x WHEN '0' THEN 'A' WHEN '1' THEN 'C' ELSE 'N' END), '/') AS bases FROM g""")
def h8(s, d):
    return _gts(s, d).select("id", "ln", "p", K.genotype_bases(F.col("gt"), F.array(F.lit("A"), F.lit("C"))).alias("bases"))


@query("H9_alternate_call", """SELECT l_suppkey AS read, count(*) FILTER (l_returnflag = 'N') / (count(*) + 1e-7) > 0.5 AS alt FROM lineitem GROUP BY 1""")
def h9(s, d):
    x = table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("read")).agg(F.count_if(F.col("l_returnflag") == "N").alias("a"), F.count_if(F.col("l_returnflag") != "N").alias("r"))
    return x.select("read", K.is_alternate(F.col("a"), F.col("r"), 0.5).alias("alt"))


_TOUR = """t AS (SELECT l_suppkey AS asm, list((CASE WHEN l_returnflag = 'A' THEN -1 ELSE 1 END * l_partkey)::INT ORDER BY l_orderkey, l_linenumber, l_partkey, l_returnflag) AS tour FROM lineitem GROUP BY 1)"""


def _tours(s, d):
    x = table(s, d, "lineitem")
    cell = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", (F.when(F.col("l_returnflag") == "A", -1).otherwise(1) * F.col("l_partkey")).cast("int").alias("v"))
    return x.groupBy(F.col("l_suppkey").alias("asm")).agg(F.transform(F.sort_array(F.collect_list(cell)), lambda c: c["v"]).alias("tour"))


@query("H10_reverse_tour", f"""WITH {_TOUR} SELECT asm, array_to_string(list_reverse(list_transform(tour, lambda x: -x)), ' ') AS tour FROM t""")
def h10(s, d):
    return _tours(s, d).select("asm", K.tour_text(K.reverse_tour(K.tour(K.tour_text(F.col("tour"))))).alias("tour"))


@query("H11_insert_after", f"""WITH {_TOUR} SELECT asm, array_to_string(flatten(list_transform(tour, lambda x: CASE WHEN abs(x) = abs(tour[1]) THEN [x, 999999] ELSE [x] END)), ' ') AS tour FROM t""")
def h11(s, d):
    return _tours(s, d).select("asm", K.tour_text(K.insert_after(F.col("tour"), F.abs(F.col("tour")[0]), F.lit(999999))).alias("tour"))


_FLAGS = """f AS (SELECT l_suppkey AS asm, l_returnflag AS part, list((CASE WHEN l_linestatus = 'F' THEN -1 ELSE 1 END * l_partkey)::INT ORDER BY l_orderkey, l_linenumber, l_partkey, l_linestatus) AS tour FROM lineitem GROUP BY ALL)"""


def _part_tours(s, d):
    cell = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_linestatus", (F.when(F.col("l_linestatus") == "F", -1).otherwise(1) * F.col("l_partkey")).cast("int").alias("v"))
    return table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("asm"), F.col("l_returnflag").alias("part")).agg(F.transform(F.sort_array(F.collect_list(cell)), lambda c: c["v"]).alias("tour"))


@query("H10_concat_tours", f"""WITH {_FLAGS} SELECT asm, array_to_string(flatten(list(tour ORDER BY part)), ' ') AS tour FROM f GROUP BY asm""")
def h10_concat(s, d):
    x = _part_tours(s, d).groupBy("asm").agg(F.transform(F.sort_array(F.collect_list(F.struct("part", "tour"))), lambda t: t["tour"]).alias("tours"))
    return x.select("asm", K.tour_text(K.concat_tours(F.col("tours"))).alias("tour"))


_STRANDS = """u AS (SELECT asm, part, abs(x) AS ctg, CASE WHEN x < 0 THEN '-' ELSE '+' END AS strand FROM (SELECT asm, part, unnest(tour) AS x, generate_subscripts(tour, 1) AS i FROM f) QUALIFY row_number() OVER (PARTITION BY asm, part, abs(x) ORDER BY i) = 1)"""


@query("H10_strands", f"""WITH {_FLAGS}, {_STRANDS} SELECT x.asm, x.ctg, x.strand || coalesce(y.strand, '') AS strands, x.strand = y.strand AS same FROM u x LEFT JOIN u y ON y.asm = x.asm AND y.ctg = x.ctg AND y.part = 'R' JOIN part ON p_partkey = x.ctg WHERE x.part = 'N' AND p_size > 25""")
def h10_strands(s, d):
    """Strands of contigs in one tour and in another, for contigs beyond a size."""
    u = _part_tours(s, d).select("asm", "part", F.explode(K.strands(F.col("tour"))).alias("x")).select("asm", "part", "x.ctg", "x.strand")
    large = table(s, d, "part").where("p_size > 25").select(F.col("p_partkey").cast("int").alias("ctg"))
    x, y = u.where("part = 'N'").drop("part"), u.where("part = 'R'").select("asm", "ctg", F.col("strand").alias("other"))
    both = x.join(y, ["asm", "ctg"], "left").join(large, "ctg", "left_semi")
    return both.select("asm", "ctg", F.concat("strand", F.coalesce("other", F.lit(""))).alias("strands"), (F.col("strand") == F.col("other")).alias("same"))


@query("H12_rebuilt_tour", """SELECT p_brand AS asm, array_to_string(list(CASE WHEN p_size % 2 = 0 THEN -p_partkey ELSE p_partkey END ORDER BY p_retailprice, p_partkey), ' ') AS tour FROM part GROUP BY 1""")
def h12(s, d):
    cell = F.struct("p_retailprice", "p_partkey", F.when(F.col("p_size") % 2 == 0, -F.col("p_partkey")).otherwise(F.col("p_partkey")).alias("v"))
    x = table(s, d, "part").groupBy(F.col("p_brand").alias("asm")).agg(F.transform(F.sort_array(F.collect_list(cell)), lambda c: c["v"]).alias("t"))
    return x.select("asm", K.tour_text(F.col("t")).alias("tour"))


@query("H13_path_label", r"""SELECT page_id, regexp_replace(regexp_replace(url, '^.*/', ''), '[.].*$', '') AS label FROM pages""")
def h13(s, d):
    return table(s, d, "pages").select("page_id", K.label_of_path(F.col("url"), r"^.*/", r"[.].*$").alias("label"))


@query("H14_rounding", """SELECT o_orderkey, ceil(o_totalprice / 7)::BIGINT AS up, floor(o_totalprice / 7)::BIGINT AS down, round(o_orderkey / 2.0)::BIGINT AS away, round_even(o_orderkey / 2.0, 0)::BIGINT AS even, round(sqrt(abs(o_totalprice)), 6) AS root FROM orders""")
def h14(s, d):
    half = F.col("o_orderkey") / 2.0
    return table(s, d, "orders").select("o_orderkey", F.ceil(F.col("o_totalprice") / 7).alias("up"), F.floor(F.col("o_totalprice") / 7).alias("down"), F.round(half).cast("long").alias("away"), F.bround(half).cast("long").alias("even"), F.round(F.sqrt(F.abs("o_totalprice")), 6).alias("root"))


@query("H15_genome_coordinate", """WITH z AS (SELECT s_nationkey AS chr, count(*) * 1000 AS size FROM supplier GROUP BY 1), o AS (SELECT chr, coalesce(sum(size) OVER (ORDER BY chr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM z) SELECT s_suppkey AS id, base + s_suppkey AS at, round(0.0001 * row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey), 6) AS genetic FROM supplier JOIN o ON chr = s_nationkey""")
def h15(s, d):
    from pyspark.sql import Window

    su = table(s, d, "supplier")
    z = su.groupBy(F.col("s_nationkey").alias("chr")).agg((F.count(F.lit(1)) * 1000).alias("size"))  # a row for each chromosome
    o = z.withColumn("base", F.coalesce(F.sum("size").over(Window.orderBy("chr").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    x = sinks.map_lines(su.select(F.col("s_nationkey").alias("chr"), F.col("s_suppkey").alias("pos")))
    return x.join(o, "chr").select(F.col("pos").alias("id"), (F.col("base") + F.col("pos")).alias("at"), F.round("genetic", 6).alias("genetic"))


_SAM = """sam AS (SELECT l_orderkey AS id, l_linenumber AS ln, l_partkey AS p, ((l_partkey * 37) % 4096)::INT AS flag, CASE WHEN l_quantity < 3 THEN '*' ELSE (l_quantity::INT)::VARCHAR || 'M' END AS cigar FROM lineitem)"""


def _sam(s, d):
    q = F.col("l_quantity")
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("p"), ((F.col("l_partkey") * 37) % 4096).cast("int").alias("flag"), F.when(q < 3, "*").otherwise(F.concat(q.cast("int").cast("string"), F.lit("M"))).alias("cigar"))


@query("B1_primary_alignments", f"""WITH {_SAM} SELECT id, ln, p, flag FROM sam WHERE cigar <> '*' AND flag & 3840 = 0""")
def b1(s, d):
    return _sam(s, d).where(K.primary(F.col("flag"), F.col("cigar"))).select("id", "ln", "p", "flag")


@query("B2_read_end", f"""WITH {_SAM} SELECT id, ln, p, CASE WHEN flag & 64 > 0 THEN 'R1' WHEN flag & 128 > 0 THEN 'R2' ELSE 'RU' END AS read_end FROM sam""")
def b2(s, d):
    return _sam(s, d).select("id", "ln", "p", K.read_end(F.col("flag")).alias("read_end"))


@query("B3_large_regions", f"""WITH {IV} SELECT seq, id, sta - 1 AS start, "end" FROM iv WHERE grp IN ('A', 'R') AND "end" - (sta - 1) > 30""")
def b3(s, d):
    return iv(s, d).where(F.col("grp").isin("A", "R") & (F.col("end") - (F.col("sta") - 1) > 30)).select("seq", "id", (F.col("sta") - 1).alias("start"), "end")


@query("B4_quality_filter", f"""WITH {IV} SELECT seq, id FROM iv WHERE "end" - sta > 30 AND sta BETWEEN 9000 AND 9600""")
def b4(s, d):
    return iv(s, d).where("end - sta > 30 and sta between 9000 and 9600").select("seq", "id")


@query("B5_keep_list", """SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12) AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)""")
def b5(s, d):
    keep = table(s, d, "supplier").where("s_nationkey < 12").select(F.col("s_suppkey").alias("l_suppkey"))
    drop = table(s, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    return table(s, d, "lineitem").join(keep, "l_suppkey", "left_semi").join(drop, "l_partkey", "left_anti").select("l_orderkey", "l_linenumber")


@query("B6_ploidy_class", f"""WITH {DEPTH} SELECT ctg, sta, CASE WHEN round(dep) <= 30 THEN 'hap' WHEN round(dep) <= 50 THEN 'dip' WHEN round(dep) <= 70 THEN 'trip' WHEN round(dep) <= 90 THEN 'tetrap' ELSE 'rep' END AS cls FROM dep""")
def b6(s, d):
    return depth(s, d).select("ctg", "sta", K.ploidy_class(F.col("dep"), 20).alias("cls"))


@query("B7_backbone", """SELECT l_suppkey AS ctg, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) / sum(l_quantity) >= 0.5 AND sum(l_quantity) >= 300 AS backbone FROM lineitem GROUP BY 1""")
def b7(s, d):
    size, hap = F.sum("l_quantity"), F.sum(F.when(F.col("l_returnflag") == "N", F.col("l_quantity")).otherwise(0))
    return table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("ctg")).agg(((hap / size >= 0.5) & (size >= 300)).alias("backbone"))


@query("B8_presence", """WITH x AS (SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN '-' WHEN 1 THEN p_size::VARCHAR ELSE p_brand END AS v FROM part) SELECT id, CASE WHEN v = '-' THEN '0' WHEN try_cast(v AS DOUBLE) IS NOT NULL THEN v ELSE '1' END AS v FROM x""")
def b8(s, d):
    v = F.when(F.col("p_size") % 3 == 0, "-").when(F.col("p_size") % 3 == 1, F.col("p_size").cast("string")).otherwise(F.col("p_brand"))
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), K.presence(v).alias("v"))


@query("B9_minor_allele_filter", """SELECT l_partkey AS pos, count(*) FILTER (l_returnflag = 'N') AS derived, count(*) FILTER (l_returnflag <> 'N') AS ancestral FROM lineitem GROUP BY 1 HAVING derived > 1 AND ancestral > 1 AND count(DISTINCT l_returnflag) <= 3""")
def b9(s, d):
    x = table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("pos")).agg(F.count_if(F.col("l_returnflag") == "N").alias("derived"), F.count_if(F.col("l_returnflag") != "N").alias("ancestral"), F.count_distinct("l_returnflag").alias("k"))
    return x.where("derived > 1 and ancestral > 1 and k <= 3").drop("k")


@query("B10_trimmed_mean", """WITH m AS (SELECT l_suppkey AS k, avg(l_quantity) AS m FROM lineitem GROUP BY 1) SELECT k, round(avg(l_quantity), 6) AS mean FROM lineitem JOIN m ON k = l_suppkey WHERE l_quantity BETWEEN 0.2 * m AND 1.8 * m GROUP BY k""")
def b10(s, d):
    m = table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.avg("l_quantity").alias("m"))
    x = table(s, d, "lineitem").select(F.col("l_suppkey").alias("k"), "l_quantity").join(m, "k")
    return x.where("l_quantity between 0.2 * m and 1.8 * m").groupBy("k").agg(F.round(F.avg("l_quantity"), 6).alias("mean"))


@query("B11_tag_by_substring", """SELECT page_id, regexp_matches(url, 'spam|bets') AS tagged FROM pages""")
def b11(s, d):
    return table(s, d, "pages").select("page_id", F.col("url").rlike("spam|bets").alias("tagged"))


def _lines(df, *cols, sep="\t"):
    return df.select(F.concat_ws(sep, *[F.col(c).cast("string") if isinstance(c, str) else c for c in cols]).alias("value"))


@query("A1_delimited_scan", """SELECT p_partkey AS id, p_name AS name, p_size::BIGINT AS size FROM part WHERE p_size <> 13""")
def a1(s, d):
    x = table(s, d, "part")
    rows = _lines(x.where("p_size <> 13"), "p_partkey", F.lit(""), "p_name", "p_size").unionByName(_lines(x.where("p_size = 13"), F.concat(F.lit("#"), F.col("p_name")), "p_size", "p_size")).unionByName(_lines(x, F.lit(" ")))
    return text.parse_fields(rows, [("id", "long"), ("name", "string"), ("size", "long")])


@query("A2_size_table", """SELECT p_brand AS ctg, min(p_size)::BIGINT AS size, count(DISTINCT p_size) > 1 AS conflict FROM part GROUP BY 1""")
def a2(s, d):
    return text.parse_sizes(_lines(table(s, d, "part"), "p_brand", "p_size"))


_PAF = """SELECT 'c' || l_suppkey AS qname, l_quantity::BIGINT AS qlen, 1::BIGINT AS qsta, l_quantity::BIGINT AS qend, 'chr' || l_linenumber AS tname, l_orderkey AS tsta, l_orderkey + l_partkey AS tend FROM lineitem"""


def _paf(s, d):
    x = table(s, d, "lineitem").withColumn("q", F.col("l_quantity").cast("long"))
    one = F.lit("1")
    return text.parse_paf(_lines(x, F.concat(F.lit("c"), F.col("l_suppkey").cast("string")), "q", one, "q", F.lit("+"), F.concat(F.lit("chr"), F.col("l_linenumber").cast("string")), F.lit("9999"), "l_orderkey", (F.col("l_orderkey") + F.col("l_partkey")).cast("string"), one, one, F.lit("60")))


@query("A3_paf", _PAF)
def a3(s, d):
    return _paf(s, d).select("qname", "qlen", "qsta", "qend", "tname", "tsta", "tend")


@query("A3_paf_filtered", f"""WITH p AS ({_PAF}) SELECT qname, tname, tsta, tend FROM p WHERE tend - tsta > 100 AND qname IN (SELECT 'c' || s_suppkey FROM supplier WHERE s_nationkey < 15)""")
def a3_filtered(s, d):
    c = table(s, d, "supplier").where("s_nationkey < 15").select(F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("ctg"))
    return text.long_targets(_paf(s, d), c, 100).select("qname", "tname", "tsta", "tend")


def _sam_lines(s, d):
    x = table(s, d, "lineitem")
    star = F.lit("*")
    rows = _lines(x, F.concat(F.lit("r"), F.col("l_orderkey").cast("string")), ((F.col("l_partkey") * 37) % 4096).cast("string"), F.concat(F.lit("c"), F.col("l_suppkey").cast("string")), "l_partkey", F.lit("60"), F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("M")), star, F.lit("0"), F.lit("0"), F.lit("ACGT"), star)
    head = _lines(table(s, d, "supplier"), F.lit("@SQ"), F.concat(F.lit("SN:c"), F.col("s_suppkey").cast("string")))
    return head.unionByName(_lines(table(s, d, "region"), F.lit("short"), "r_name")).unionByName(rows)


@query("A4_sam", """SELECT 'r' || l_orderkey AS qname, ((l_partkey * 37) % 4096)::INT AS flag, 'c' || l_suppkey AS rname, l_partkey AS pos, (l_quantity::INT)::VARCHAR || 'M' AS cigar FROM lineitem""")
def a4(s, d):
    return text.parse_sam(_sam_lines(s, d)).select("qname", "flag", "rname", "pos", "cigar")


@query("A4_counts", """WITH f AS (SELECT (l_partkey * 37) % 4096 AS flag FROM lineitem), n AS (SELECT (SELECT count(*) FROM supplier) AS headers, (SELECT count(*) FROM region) AS short) SELECT count(*) + headers + short AS lines, headers, short, count(*) AS records, count(*) FILTER (flag & 4 <> 0) AS unmapped, count(*) FILTER (flag & 256 <> 0) AS secondary, count(*) FILTER (flag & 2048 <> 0) AS supplementary FROM f, n GROUP BY headers, short""")
def a4_counts(s, d):
    return text.sam_counts(_sam_lines(s, d))


@query("A5_vcf", """SELECT (l_orderkey % 4)::VARCHAR AS chr, l_orderkey AS pos, 's' || k AS sample, CASE k WHEN 1 THEN '0/' || (l_partkey % 2) ELSE (l_suppkey % 2) || '|1' END AS gt FROM lineitem, generate_series(1, 2) t(k)""")
def a5(s, d):
    x = table(s, d, "lineitem")
    rows = _lines(x, (F.col("l_orderkey") % 4).cast("string"), "l_orderkey", F.lit("."), F.lit("A"), F.lit("C"), F.lit("50"), F.lit("."), F.lit("."), F.lit("GT:DP"), F.concat(F.lit("0/"), (F.col("l_partkey") % 2).cast("string"), F.lit(":3")), F.concat((F.col("l_suppkey") % 2).cast("string"), F.lit("|1:7")))
    head = s.createDataFrame([("##fileformat=VCFv4.2",), ("#" + "\t".join("CHROM POS ID REF ALT QUAL FILTER INFO FORMAT s1 s2".split()),)], "value string")
    return text.parse_vcf(rows.unionByName(head), text.vcf_samples(head)).select("chr", "pos", "sample", "gt")


@query("A6_genotype_tuples", """SELECT l_orderkey AS id, l_linenumber AS ln, l_partkey AS p, (l_suppkey % 3)::INT + (l_partkey % 2)::INT AS dosage FROM lineitem""")
def a6(s, d):
    g = F.concat((F.col("l_suppkey") % 3).cast("string"), F.lit("|"), (F.col("l_partkey") % 2).cast("string"))
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("p"), F.aggregate(text.genotype_tuple(g), F.lit(0), lambda a, x: a + x).alias("dosage"))


@query("A7_fasta", """SELECT 'd' || doc_id AS name, regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g') AS seq FROM documents""")
def a7(s, d):
    letters = K.wrapped(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", ""), 60)
    return text.parse_fasta(table(s, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(" note\n"), letters, F.lit("\n")).alias("value")))


@query("A8_gfa_links", """SELECT 'u' || l_suppkey AS a, CASE WHEN l_quantity < 25 THEN 'r' ELSE 'l' END AS a_end, 'u' || l_partkey AS b, CASE WHEN l_tax < 0.04 THEN 'l' ELSE 'r' END AS b_end, l_quantity::BIGINT AS ovl FROM lineitem WHERE l_linenumber <> 2""")
def a8(s, d):
    sign = lambda c: F.when(c, "+").otherwise("-")
    u = lambda c: F.concat(F.lit("u"), F.col(c).cast("string"))
    n = F.when(F.col("l_linenumber") == 2, "0").otherwise(F.col("l_quantity").cast("int").cast("string"))
    rows = _lines(table(s, d, "lineitem"), F.lit("L"), u("l_suppkey"), sign(F.col("l_quantity") < 25), u("l_partkey"), sign(F.col("l_tax") < 0.04), F.concat(n, F.lit("M")))
    return text.parse_gfa_links(rows)


@query("A9_genes", """SELECT 'chr' || (p_partkey % 5) AS chr, p_partkey AS sta, p_partkey + p_size AS "end", '+' AS strand, p_name AS id FROM part WHERE p_size > 10""")
def a9(s, d):
    x = table(s, d, "part")
    dot = F.lit(".")
    rows = _lines(x, F.concat(F.lit("chr"), (F.col("p_partkey") % 5).cast("string")), F.lit("src"), F.when(F.col("p_size") > 10, "gene").otherwise("exon"), "p_partkey", (F.col("p_partkey") + F.col("p_size")).cast("string"), dot, F.lit("+"), dot, F.concat(F.lit("ID="), F.col("p_name"), F.lit(";Note=x")))
    return text.parse_genes(rows)


@query("A10_dot_edges", """SELECT 'a' || l_suppkey AS a, 'b' || l_partkey AS b, l_quantity AS weight, (l_linenumber)::INT AS cluster FROM lineitem""")
def a10(s, d):
    e = table(s, d, "lineitem").select(F.concat(F.lit("a"), F.col("l_suppkey").cast("string")).alias("a"), F.concat(F.lit("b"), F.col("l_partkey").cast("string")).alias("b"), F.col("l_quantity").alias("weight"), F.col("l_linenumber").alias("cluster"))
    return text.parse_dot_edges(sinks.dot_edge_lines(e))


def _dot_graph(s, d):
    """Contacts of suppliers with nations, a cluster for each region, as DOT lines of one file."""
    n = table(s, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("cluster"))
    e = table(s, d, "supplier").join(n, "s_nationkey").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("a"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("b"), F.round("s_acctbal").alias("weight"), "cluster")
    z = table(s, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"), (F.col("s_suppkey") * 10).alias("size"))
    return sinks.dot_clusters(e, z)


@query("A10_dot_groups", """SELECT DISTINCT n_regionkey AS cluster, 'G_' || n_regionkey AS label FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def a10_groups(s, d):
    x = _dot_graph(s, d)
    one = x.select("value", F.lit("g").alias("file"), (F.col("cluster").cast("long") * (1 << 45) + F.col("line_no")).alias("line_no"))
    return text.parse_dot_groups(one).select("cluster", "label")


@query("A19_dot_clusters", """SELECT n_regionkey AS cluster, '/* ' || (count(DISTINCT s_suppkey) + count(DISTINCT s_nationkey)) || ' contigs with total size of ' || sum(s_suppkey * 10) || ' bp */' AS value, 2 * count(*) + count(DISTINCT s_nationkey) + 4 AS lines FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""")
def a19_dot(s, d):
    x = _dot_graph(s, d)
    return x.groupBy("cluster").agg(F.max(F.when(F.col("value").contains("contigs with"), F.trim(F.translate("value", "\t", " ")))).alias("value"), F.count(F.lit(1)).alias("lines"))


def _folder(s):
    from locuspark.scratch import Scratch

    return Scratch(s).root


@query("A15_headed_scan", """SELECT p_partkey AS id, p_name AS name, p_retailprice AS price FROM part""")
def a15(s, d):
    path = _folder(s) + "/headed"
    sinks.write_tsv(table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price")), path, header=True)
    return text.read_headed(s, path, "id long, name string, price double")


@query("A16_files_by_key", """SELECT l_orderkey AS read, l_linenumber AS n, l_returnflag AS homlg, l_linestatus AS lg FROM lineitem""")
def a16(s, d):
    path = _folder(s) + "/by_key"
    x = table(s, d, "lineitem").select(F.col("l_orderkey").alias("read"), F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("homlg"), F.col("l_linestatus").alias("lg"))
    sinks.write_by(x, path, "homlg", "lg")
    return s.read.schema("read long, n int, homlg string, lg string").parquet(path)


@query("A11_blast", """SELECT conv_id::VARCHAR AS query, 's' || max(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS subject, turn AS same, (turn + 10) AS length FROM conversations""")
def a11(s, d):
    c = table(s, d, "conversations").select("conv_id", "turn")
    t, i = F.col("turn").cast("string"), F.col("conv_id").cast("string")
    heads = c.select("conv_id").distinct().select(i.alias("file"), F.lit(-1).cast("long").alias("line_no"), F.concat(F.lit("Query= "), i).alias("value"))
    subjects = c.select(i.alias("file"), (F.col("turn") * 2).alias("line_no"), F.concat(F.lit("> s"), t).alias("value"))
    hits = c.select(i.alias("file"), (F.col("turn") * 2 + 1).alias("line_no"), F.concat(F.lit(" Identities = "), t, F.lit("/"), (F.col("turn") + 10).cast("string")).alias("value"))
    return text.parse_blast(heads.unionByName(subjects).unionByName(hits)).select("query", "subject", "same", "length")


@query("A12_matrix_blocks", """SELECT 'f' AS file, (n_regionkey + 1)::BIGINT AS block, n_name AS row, k::INT AS "column", (n_nationkey * k)::DOUBLE AS dist FROM nation, generate_series(0, 2) t(k)""")
def a12(s, d):
    n = table(s, d, "nation")
    num = lambda k: (F.col("n_nationkey") * k).cast("string")
    name = F.translate(F.col("n_name"), " ", "_")
    rows = n.select(F.lit("f").alias("file"), (F.col("n_regionkey") * 1000 + 1 + F.col("n_nationkey")).cast("long").alias("line_no"), F.concat_ws(" ", F.col("n_name"), num(0), num(1), num(2)).alias("value"))
    heads = n.select("n_regionkey").distinct().select(F.lit("f").alias("file"), (F.col("n_regionkey") * 1000).cast("long").alias("line_no"), F.lit("5").alias("value"))
    return text.parse_matrix_blocks(rows.unionByName(heads))


@query("A13_agp", """SELECT 'chr' || (p_partkey % 5) AS chr, p_partkey AS sta, p_partkey + p_size AS "end", p_name AS ctg FROM part WHERE p_size > 10""")
def a13(s, d):
    rows = _lines(table(s, d, "part"), F.concat(F.lit("chr"), (F.col("p_partkey") % 5).cast("string")), "p_partkey", (F.col("p_partkey") + F.col("p_size")).cast("string"), F.lit("1"), F.when(F.col("p_size") > 10, "W").otherwise("U"), "p_name")
    return text.parse_agp(rows).select("chr", "sta", "end", "ctg")


@query("A14_file_labels", """SELECT page_id, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '[?#].*$', '') AS label FROM pages""")
def a14(s, d):
    return text.labelled(table(s, d, "pages").select("page_id", F.col("url").alias("file")), r"[?#].*$").select("page_id", "label")


@query("A17_bed_lines", f"""WITH {IV} SELECT seq || chr(9) || (sta - 1) || chr(9) || "end" || chr(9) || grp AS value FROM iv""")
def a17(s, d):
    return sinks.bed_lines(iv(s, d), "seq", "sta", "end", "grp")


@query("A18_fasta_lines", """SELECT '>' || p_name || chr(10) || p_type AS value FROM part""")
def a18(s, d):
    return sinks.fasta_lines(table(s, d, "part"), "p_name", "p_type")


@query("A19_cluster_lines", """SELECT s_nationkey AS cluster, array_to_string(list_sort(list(s_suppkey::VARCHAR)), ',') AS nodes, round(sum(s_acctbal), 2) AS total FROM supplier GROUP BY 1""")
def a19(s, d):
    x = table(s, d, "supplier").select(F.col("s_nationkey").alias("cluster"), F.col("s_suppkey").alias("node"), F.col("s_acctbal").alias("size"))
    return sinks.cluster_lines(x, "cluster", "node", "size").withColumn("total", F.round("total", 2))


@query("A20_haplotype_lines", """SELECT l_suppkey AS sample, array_to_string(list(CASE l_returnflag WHEN 'A' THEN '0' WHEN 'N' THEN '1' ELSE '9' END ORDER BY l_orderkey, l_linenumber, l_partkey, l_returnflag DESC), ' ') AS line FROM lineitem GROUP BY 1""")
def a20(s, d):
    x = table(s, d, "lineitem").select(F.col("l_suppkey").alias("sample"), "l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).alias("state"))
    return sinks.haplotype_lines(x, "sample", ["l_orderkey", "l_linenumber", "l_partkey"], "state")


_PLINK = """g AS (SELECT l_suppkey % 3 AS chr, l_partkey AS pos, l_linenumber AS sample, min(l_returnflag) AS a1, max(l_returnflag) AS a2 FROM lineitem GROUP BY ALL)"""


def _plink(s, d):
    return table(s, d, "lineitem").groupBy((F.col("l_suppkey") % 3).alias("chr"), F.col("l_partkey").alias("pos"), F.col("l_linenumber").alias("sample")).agg(F.min("l_returnflag").alias("a1"), F.max("l_returnflag").alias("a2"))


@query("A20_eigenstrat_map", f"""WITH {_PLINK}, s AS (SELECT DISTINCT chr, pos FROM g), e AS (SELECT chr, max(pos) AS last FROM s GROUP BY chr) SELECT chr, chr || ':' || pos AS id, round(0.0001 * row_number() OVER (ORDER BY chr, pos), 6) AS genetic, pos + coalesce((SELECT sum(last) FROM e WHERE e.chr < s.chr), 0)::BIGINT AS at FROM s""")
def a20_map(s, d):
    sites = _plink(s, d).select("chr", "pos").distinct().withColumn("id", F.concat_ws(":", F.col("chr").cast("string"), F.col("pos").cast("string")))
    return sinks.eigenstrat_map(sites)


@query("A20_ped", f"""WITH {_PLINK}, l AS (SELECT sample, string_agg(a1 || chr(9) || a2, chr(9) ORDER BY g.chr, pos) AS line FROM g GROUP BY sample) SELECT sample, concat_ws(chr(9), row_number() OVER (ORDER BY sample), sample, '0', '0', '0', '1', line) AS value FROM l""")
def a20_ped(s, d):
    return sinks.ped_lines(_plink(s, d), ["chr", "pos"])


@query("A20_geno", f"""WITH {_PLINK}, w AS (SELECT g.chr AS c, pos, max(a1 || '/' || a2) FILTER (sample = 1) AS s1, max(a1 || '/' || a2) FILTER (sample = 2) AS s2, max(a1 || '/' || a2) FILTER (sample = 3) AS s3 FROM g GROUP BY ALL) SELECT c AS chr, pos, concat_ws(chr(9), c, pos, coalesce(s1, 'N/N'), coalesce(s2, 'N/N'), coalesce(s3, 'N/N')) AS value FROM w""")
def a20_geno(s, d):
    return sinks.geno_lines(_plink(s, d).withColumn("sample", F.col("sample").cast("string")), ["chr", "pos"], ["1", "2", "3"])
