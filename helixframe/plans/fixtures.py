"""Genomic tables derived from the general test tables, in SQL that Spark and other engines read alike.

Each view is a select over base tables, written as {name}, or over other views, written as <name>.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_CHR = "case {0} % 25 when 22 then 'X' when 23 then 'Y' when 24 then 'M' else cast({0} % 25 + 1 as string) end"
_LETTERS = "translate(upper({0}), 'BDEFHIJKLMNOPQRSUVWXYZ', 'CTACATGACTGACNTGACTNGN')"

VIEWS = {
    # Names of chromosomes have "chr" in half of the samples.
    "counted": f"""select l_suppkey % 10 as sample, concat(case when l_suppkey % 2 = 0 then 'chr' else '' end, {_CHR.format("l_partkey")}) as chr,
        l_partkey as pos, l_linenumber % 6 as cls, cast(l_quantity as bigint) as w, l_partkey % 3 + 1 as d from {{lineitem}}""",
    "counts": """select sample, chr, pos, cast(sum(case when cls = 0 then w else 0 end) as bigint) as nA, cast(sum(case when cls = 1 then w else 0 end) as bigint) as nC,
        cast(sum(case when cls = 2 then w else 0 end) as bigint) as nG, cast(sum(case when cls = 3 then w else 0 end) as bigint) as nT,
        cast(0 as bigint) as nN, cast(0 as bigint) as nX0, cast(0 as bigint) as nX1,
        cast(sum(case when cls = 4 then w else 0 end) as bigint) as nI, cast(sum(case when cls = 5 then w else 0 end) as bigint) as nD,
        concat(case when sum(case when cls = 5 then w else 0 end) > 0 then concat('*', cast(max(d) as string), '=', cast(cast(sum(case when cls = 5 then w else 0 end) as bigint) as string)) else '' end,
               case when sum(case when cls = 5 then w else 0 end) > 0 and sum(case when cls = 4 then w else 0 end) > 0 then ';' else '' end,
               case when sum(case when cls = 4 then w else 0 end) > 0 then concat('^AC=', cast(cast(sum(case when cls = 4 then w else 0 end) as bigint) as string)) else '' end) as indels
        from <counted> group by sample, chr, pos""",
    "regions": f"""select concat('chr', {_CHR.format("p_partkey")}) as chr, p_partkey as start, p_partkey + p_size as "end", p_brand as gene from {{part}}""",
    "bases": f"""select concat('chr', {_CHR.format("p_partkey")}) as chr, p_partkey as pos, substr('ACGT', cast(p_partkey % 4 as int) + 1, 1) as ref from {{part}}""",
    "seqs": f"""select doc_id as seq_id, {_LETTERS.format("regexp_replace(text, '[^A-Za-z]', '', 'g')")} as seq from {{documents}}""",
    "reference": f"""select item_id as seq_id, {_LETTERS.format("regexp_replace(text, '[^A-Za-z]', '', 'g')")} as seq from {{benchmark}}""",
    "pairs": """select seq_id as pair_id, seq as seq1, translate(reverse(seq), 'ACGT', 'TGCA') as seq2 from <seqs>""",
    "alleles": """select concat('locus', cast(seq_id % 5 as string)) as locus, concat('allele', cast(seq_id as string)) as allele, seq from <reference>""",
    "alignments": f"""select l_orderkey as id, concat('chr', {_CHR.format("l_partkey")}) as chr, 1000 + l_partkey as pos,
        case l_orderkey % 6 when 0 then '10M' when 1 then '4M1I5M' when 2 then '4M2D6M' when 3 then '3S7M' when 4 then '7M3S' else '2H8M' end as cigar,
        substr('ACGTTGCAACGGTCA', cast(l_linenumber % 5 as int) + 1, 10) as seq, cast(case when l_suppkey % 11 = 0 then 4 else 16 * (l_suppkey % 2) + 1 end as int) as flags,
        cast(l_quantity * 100 - 500 as int) as tlen from {{lineitem}}""",
    "features": """select concat('gene', cast(n_nationkey as string)) as id, cast(null as string) as parent, 'gene' as type, concat('chr', cast(n_nationkey % 22 + 1 as string)) as chr, cast(1000 as bigint) as start, cast(9000 as bigint) as "end" from {nation}
        union all select concat('tx', cast(k as string), '_', cast(n_nationkey as string)), concat('gene', cast(n_nationkey as string)), 'transcript', concat('chr', cast(n_nationkey % 22 + 1 as string)), cast(1000 as bigint), cast(9000 as bigint) from {nation} join (select 1 as k union all select 2 union all select 3) s on true
        union all select concat('exon', cast(s_suppkey as string)), concat('tx', cast(s_suppkey % 3 + 1 as string), '_', cast(s_nationkey as string)), 'exon', concat('chr', cast(s_nationkey % 22 + 1 as string)), 1000 + s_suppkey * 7 % 2500, 1000 + s_suppkey * 7 % 2500 + 120 from {supplier}""",
    "genes": f"""select concat('chr', {_CHR.format("p_partkey")}) as chrom, p_partkey * 40 as "txStart", p_partkey * 40 + p_size * 30 as "txEnd" from {{part}}""",
    "transcripts": f"""select concat('NM_', cast(p_partkey as string)) as accession, concat('chr', {_CHR.format("p_partkey")}) as chr, case when p_size % 2 = 0 then '+' else '-' end as strand,
        1000 + p_partkey as "txStart", 1000 + p_partkey + 90 as "txEnd", 1000 + p_partkey + 15 as "cdsStart", 1000 + p_partkey + 70 as "cdsEnd" from {{part}}""",
    "alleles_vcf": f"""select l_orderkey * 10 + l_linenumber as id, concat('chr', {_CHR.format("l_partkey")}) as chr, 1000 + l_partkey as pos,
        case l_linenumber when 1 then 'A' when 2 then 'C' when 3 then 'GATTA' when 4 then 'ACGT' when 5 then 'CCATG' when 6 then 'GAA' else 'T' end as ref,
        case l_linenumber when 1 then 'G' when 2 then 'CTT,T' when 3 then 'G' when 4 then 'ATT' when 5 then 'CATGG' when 6 then 'GTT' else 'C,G' end as alt from {{lineitem}}""",
    "descriptions": f"""select l_orderkey * 10 + l_linenumber as id, concat('NC_0000', cast(l_partkey % 24 + 10 as string), '.', cast(l_suppkey % 9 + 1 as string), ':g.', cast(1000 + l_partkey as string),
        case l_linenumber when 1 then 'A>G' when 2 then concat('_', cast(1001 + l_partkey as string), 'insACGT') when 3 then 'del' when 4 then concat('_', cast(1004 + l_partkey as string), 'delACGTA')
        when 5 then concat('_', cast(1003 + l_partkey as string), 'inv') when 6 then 'dupA' else concat('_', cast(1002 + l_partkey as string), 'delinsTT') end) as text from {{lineitem}}""",
}


def expanded(view: str) -> str:
    """The select of a view, with those that it reads put in."""
    return re.sub(r"<(\w+)>", lambda m: f"({expanded(m[1])}) as {m[1]}_v", VIEWS[view])


def for_spark(sql: str, sf_dir: str) -> str:
    sql = re.sub(r"\{(\w+)\}", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", sql)
    sql = re.sub(r'"(\w+)"', r"`\1`", sql)
    return sql.replace(", '', 'g')", ", '')")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(for_spark(expanded(name), sf_dir))


def with_views(sql: str) -> str:
    """SQL for another engine: the views that ``sql`` names as <view>, before it as common table expressions."""
    used: list[str] = []

    def use(text: str) -> None:
        for name in re.findall(r"<(\w+)>", text):
            if name not in used:
                use(VIEWS[name])
                used.append(name)

    use(sql)
    plain = lambda t: re.sub(r"\{(\w+)\}", r"\1", re.sub(r"<(\w+)>", r"v_\1", t))
    if not used:
        return plain(sql)
    ctes = ", ".join(f"v_{n} as ({plain(VIEWS[n])})" for n in used)
    rest = plain(sql).strip()
    return f"with recursive {ctes}, {rest[5:]}" if rest.startswith("with ") else f"with recursive {ctes} {rest}"
