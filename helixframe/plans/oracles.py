"""The queries of plans.queries in plain SQL, written without the library's operators, to hold the results against."""

from __future__ import annotations

from helixframe.functions.chrom import HG19
from helixframe.functions.kmers import ROUNDS
from helixframe.plans.fixtures import with_views

_COUNTS = ("nA", "nC", "nG", "nT", "nN", "nX0", "nX1", "nI", "nD")
_KEY = "case when regexp_full_match({0}, '(chr)?([1-9]|1[0-9]|2[0-2]|X|Y)') then replace({0}, 'chr', '') else concat('raw:', {0}) end"
_ORD = "case when regexp_full_match({0}, '(chr)?([1-9]|1[0-9]|2[0-2])') then cast(replace({0}, 'chr', '') as int) when {0} in ('X', 'chrX') then 23 when {0} in ('Y', 'chrY') then 24 end"
_SUMS = ", ".join(f"cast(sum({c}) as bigint) as {c}" for c in _COUNTS)
_WHOLE = f"(select {_KEY.format('chr')} as key, min(chr) as chr, pos, {_SUMS} from <counts> group by 1, 3)"
_NAMED = f"(select concat('chr', replace(chr, 'chr', '')) as chr, pos, {_SUMS} from <counts> group by 1, 2)"
_ST, _GT = "(s.nA+s.nC+s.nG+s.nT+s.nI+s.nD)", "(g.nA+g.nC+g.nG+g.nT+g.nI+g.nD)"
_TERM = " + ".join(f"case when s.{c} = 0 then 0 else s.{c}::double / {_ST} * ln((s.{c}::double * {_GT}) / (g.{c}::double * {_ST})) end" for c in ("nA", "nC", "nG", "nT", "nI", "nD"))
_SCORES = f"(select sample, s.chr, s.pos, {_KEY.format('s.chr')} as key, case when {_ST} = 0 then 0 else {_TERM} end as kld from <counts> s join {_WHOLE} g on g.key = {_KEY.format('s.chr')} and g.pos = s.pos)"
_FIT = "min(chr) as chr, pos, count(*) as n, coalesce(sum(case when kld > 0 then kld end), 0) as sx, coalesce(sum(case when kld > 0 then ln(kld) end), 0) as slx, coalesce(sum(case when kld > 0 then kld * ln(kld) end), 0) as sxlx"
_STATS = f"(select key, {_FIT} from {_SCORES} x group by key, pos)"
_V = "(n * sxlx - sx * slx)"
_K, _THETA = f"case when {_V} > 1e-12 then n * sx / {_V} else sx / n / 0.01 end", f"case when {_V} > 1e-12 then {_V} / (n * n) else 0.01 end"
_GENOME = "(select chrom, size, coalesce(sum(size) over (order by chrom rows between unbounded preceding and 1 preceding), 0)::bigint as start from (values " + ", ".join(f"('{c}', {n})" for c, n in HG19.items()) + ") t(chrom, size))"

#: Events of an alignment: the operations with what the read and the reference have used up before them.
_OPS = """(select id, chr, pos, seq, i, op, len, coalesce(sum(case when op in ('M', 'D') then len end) over w, 0) as rb, coalesce(sum(case when op in ('M', 'I', 'S') then len end) over w, 0) as qb, rid
    from (select *, row_number() over () as rid from <alignments> where flags & 4 = 0) a, (select c, unnest(regexp_extract_all(c, '([0-9]+)([MIDSH])', 2)) as op, unnest(regexp_extract_all(c, '([0-9]+)([MIDSH])', 1))::bigint as len, unnest(range(20)) as i from (select distinct cigar as c from <alignments>)) o
    where o.c = a.cigar and op is not null window w as (partition by rid order by i rows between unbounded preceding and 1 preceding))"""
_ATOMS = f"""(select chr, pos + rb + j as pos, substr(seq, (qb + j + 1)::int, 1) as base from (select *, unnest(range(len)) as j from {_OPS} o where op = 'M') m
    union all select chr, pos + rb - 1, case op when 'I' then 'I' when 'D' then 'D' else case when i = 0 then '<' else '>' end end from {_OPS} o where op in ('I', 'D', 'S')
    union all select chr, pos + rb - 1, case op when 'I' then concat('^', substr(seq, (qb + 1)::int, len::int)) else concat('*', len) end from {_OPS} o where op in ('I', 'D'))"""
_PILE = f"(select chr, pos, base, count(*) as n from {_ATOMS} a group by all)"
_EVENTS = {"A": "nA", "C": "nC", "G": "nG", "T": "nT", "N": "nN", ">": "nX0", "<": "nX1", "I": "nI", "D": "nD"}


def _kmers(view: str, k: int, extra: str = "") -> str:
    return f"(select * from (select seq_id{extra}, pos, substr(seq, pos::int + 1, {k}) as kmer from (select *, unnest(range(0, length(seq) - {k} + 1)) as pos from <{view}>) u) x where regexp_full_match(kmer, '[ACGT]+'))"


def _rc(c: str) -> str:
    return f"translate(reverse({c}), 'ACGT', 'TGCA')"


def _packed(c: str, k: int) -> str:
    """Two bits to a base, by position."""
    return " + ".join(f"(strpos('ACGT', substr({c}, {i + 1}, 1)) - 1)::bigint * {4 ** (k - 1 - i)}::bigint" for i in range(k))


def _murmur(x: str, seed: int, source: str, keep: str) -> str:
    """A select of keep and h from ``source``, the hash of the long x in steps over huge integers."""
    m = 2**32
    rot = lambda v, r: f"((({v}) * {2**r}) % {m} + (({v}) // {2 ** (32 - r)}))"
    q = f"select {keep}, ({x})::hugeint as x, {seed}::hugeint as h from {source}"
    for word in (f"(x // {m})", f"(x % {m})"):
        q = f"select * exclude (w), ({word} * 3432918353) % {m} as w from (select *, 0 as w from ({q}))"
        q = f"select * replace (({rot('w', 15)} * 461845907) % {m} as w) from ({q})"
        q = f"select * exclude (w) replace (xor(h::ubigint, w::ubigint)::hugeint as h) from ({q})"
        q = f"select * replace (({rot('h', 13)} * 5 + 3864292196) % {m} as h) from ({q})"
    q = f"select * replace (xor(h::ubigint, 8::ubigint)::hugeint as h) from ({q})"
    for shift, factor in ((16, 2246822507), (13, 3266489909)):
        q = f"select * replace ((xor(h::ubigint, (h // {2**shift})::ubigint)::hugeint * {factor}) % {m} as h) from ({q})"
    return f"(select * exclude (x) replace (xor(h::ubigint, (h // 65536)::ubigint)::bigint as h) from ({q}))"


def _hist(source: str) -> str:
    return f"select n as multiplicity, count(*) as n_kmers from (select kmer, count(*) as n from {source} s group by kmer) group by n"


_CANON = "(select least(kmer, {rc}) as kmer from {src} c)"
_PAIR_KMERS = "(select pair_id, mate, '+' as strand, kmer from {0} union all select pair_id, mate, '-', {1} from {0})"


def _pair(k: int) -> str:
    one = lambda m: f"select * from (select pair_id, {m} as mate, substr(seq{m}, pos::int + 1, {k}) as kmer from (select *, unnest(range(0, length(seq{m}) - {k} + 1)) as pos from <pairs>) u) where regexp_full_match(kmer, '[ACGT]+')"
    both = f"({one(1)} union all {one(2)})"
    return f"(select pair_id, mate, '+' as strand, kmer from {both} p union all select pair_id, mate, '-', {_rc('kmer')} from {both} p)"


_LABELS = "(select kmer, case when min(seq_id) = max(seq_id) then min(seq_id) + 1 else 0 end as label from {0} k group by kmer)"
#: Depth of the spans at every border.
_SPANS = f"(select start + \"txStart\" as a, start + \"txEnd\" as z from (select distinct * from <genes>) g join {_GENOME} m on m.chrom = g.chrom)"
_EDGES = "(select p, sum(d) as d from (select a as p, 1 as d from {0} s where z > a union all select z, -1 from {0} s where z > a) group by p)"
_DEPTH = f"(select p as a, lead(p) over (order by p) as z, sum(d) over (order by p) as depth from {_EDGES.format(_SPANS)} e)"
_EX = ((0, 30), (45, 60), (75, 90))
_DESC = r"regexp_extract(text, '^([^:]+)[.]([0-9]+):g[.]([0-9]+)', {0})"
_KIND = "case when text like '%>%' then 'sub' when text like '%delins%' then 'delins' when text like '%\\_%del%' escape '\\' and text like '%delACGTA' then 'del' when text like '%ins%' then 'ins' when text like '%del' then 'del' when text like '%dup%' then 'dup' else 'inv' end"
_PARSED = f"""(select id, {_KIND} as kind, {_DESC.format(1)} as acc, {_DESC.format(2)}::bigint as version, {_DESC.format(3)}::bigint as first,
    coalesce(nullif(regexp_extract(text, ':g[.][0-9]+_([0-9]+)', 1), '')::bigint, {_DESC.format(3)}::bigint) as last, case when text like '%>%' then 'A' when text like '%delACGTA' then 'ACGTA' when text like '%dup%' then 'A' else '' end as ref,
    case when text like '%>%' then 'G' when text like '%insACGT' then 'ACGT' when text like '%delinsTT' then 'TT' else '' end as alt from <descriptions>)"""

SQL: dict[str, str] = {
    "kld_fit": f"select chr, pos, n, round(sx, 6) as sx, round(slx, 6) as slx, round(sxlx, 6) as sxlx, round({_K}, 3) as k, round({_THETA}, 6) as theta from {_STATS} f",
    "pileup_counts": f"select chr, pos, {', '.join(f'''coalesce(sum(case when base = '{e}' then n end), 0)::bigint as {c}''' for e, c in _EVENTS.items())}, coalesce(string_agg(case when length(base) > 1 then concat(base, '=', n) end, ';' order by base), '') as indels from {_PILE} p group by chr, pos",
    "pileup_long_regions": f'select chr, pos, base, n as count from {_PILE} p where exists (select 1 from <regions> r where r.chr = p.chr and p.pos >= r.start + 1000 and p.pos < r."end" + 1000)',
    "counts_merge": f"select chr, pos, {', '.join(_COUNTS)} from {_WHOLE} w",
    "counts_merge_indels": f"""select w.chr, w.pos, coalesce(i.indels, '') as indels from {_WHOLE} w left join (select key, pos, string_agg(concat(k, '=', v), ';' order by k) as indels from (select {_KEY.format('chr')} as key, pos, split_part(p, '=', 1) as k, sum(split_part(p, '=', 2)::bigint)::bigint as v from (select chr, pos, unnest(string_split(indels, ';')) as p from <counts>) where p <> '' group by all) group by key, pos) i on i.key = w.key and i.pos = w.pos""",
    "gene_group": f'select gene, count(*) as len, sum(n)::bigint as cnt from (select distinct w.chr, w.pos, gene, nA+nC+nG+nT+nI+nD as n from {_WHOLE} w join <regions> r on r.chr = w.chr and w.pos >= r.start and w.pos < r."end") group by gene',
    "kld_dist": f"select sample, chr, pos, round(kld, 6) as kld, 1.0::double as pval from {_SCORES} s",
    "gamma_fit_merge": f"select chr, pos, n, round(sx, 6) as sx, round(slx, 6) as slx, round(sxlx, 6) as sxlx from {_STATS} f",
    "gamma_pval": f"""select sample, chr, pos, round(kld, 6) as kld, round(case when kld <= 0 then 1.0 when k <= 0 then 0.0 else greatest(0.0, 1 - list_sum(list_transform(range(0, 1200), lambda i: exp(-x + (k + i) * ln(x) - lgamma(k + i + 1))))) end, 4) as pval
        from (select s.sample, s.chr, s.pos, s.kld, {_K} as k, greatest(s.kld, 1e-300) / ({_THETA}) as x from {_SCORES} s join {_STATS} f on f.key = s.key and f.pos = s.pos)""",
    "annot_loci": f"""select chr, pos, nA, cov, ref, split_part(alt, ' ', 2) as alt, round(own::double / cov, 6) as raf, round(split_part(alt, ' ', 1)::double / cov, 6) as vaf, round(pval, 6) as pval, '' as exac from (
        select w.chr, w.pos, nA, nA+nC+nG+nT+nI+nD as cov, ref, case ref when 'A' then nA when 'C' then nC when 'G' then nG else nT end as own, 1.0 / (1 + nA) as pval,
        greatest(case when ref <> 'A' then concat(lpad(nA::varchar, 12, '0'), ' A') end, case when ref <> 'C' then concat(lpad(nC::varchar, 12, '0'), ' C') end, case when ref <> 'G' then concat(lpad(nG::varchar, 12, '0'), ' G') end, case when ref <> 'T' then concat(lpad(nT::varchar, 12, '0'), ' T') end, concat(lpad(nI::varchar, 12, '0'), ' I'), concat(lpad(nD::varchar, 12, '0'), ' D')) as alt
        from {_NAMED} w left join <bases> b on b.chr = w.chr and b.pos = w.pos) where pval <= 0.05""",
    "call_variants": "",
    "vcf_lines": "",
    "exon_read_counts": """select e.id, concat(e.id, '/', t.id, '/', t.parent) as path, (select count(*) from <alignments> a where a.chr = e.chr and flags & 4 = 0 and tlen between 0 and 4096 and a.pos < e."end" and a.pos + greatest(tlen, 1) > e.start)::bigint as n
        from (select distinct * from <features>) e join (select distinct id, parent from <features>) t on t.id = e.parent where e.type = 'exon'""",
    "feature_parent_paths": "select id, path from (with recursive up(id, next, path) as (select id, parent, id from <features> union select up.id, f.parent, concat(up.path, '/', f.id) from up join (select distinct id, parent from <features>) f on f.id = up.next) select * from up) where next is null",
    "tx_span_stats": f"""select (select count(*) from {_SPANS} s) as n, (select sum(z - a)::bigint from {_SPANS} s) as total, sum(z - a)::bigint as covered, round(sum((z - a) * depth)::double / sum(z - a), 6) as mean_depth, max(depth)::bigint as max_depth,
        round(sum(z - a)::double / (select sum(size) from {_GENOME} g), 12) as fraction from {_DEPTH} d where depth > 0""",
    "tx_depth_hist": f"select depth::bigint as depth, sum(z - a)::bigint as bases from {_DEPTH} d where depth > 0 group by depth",
    "interval_segments": """select s.chr, s.p as start, s.z as "end", string_agg(distinct gene, ',' order by gene) as labels from (select chr, p, lead(p) over (partition by chr order by p) as z from (select chr, start as p from <regions> union select chr, "end" from <regions>)) s
        join <regions> r on r.chr = s.chr and r.start < s.z and r."end" > s.p where z is not null group by all""",
    "interval_overlap": 'select a.gene as a, b.gene as b, count(*) as n, sum(a.start)::bigint as at from <regions> a join <regions> b on a.chr = b.chr and a.start < b."end" + 3 and b.start + 7 < a."end" and a."end" > a.start and b."end" + 3 > b.start + 7 group by all',
    "region_filter": f'select chr, pos, nA from {_WHOLE} w where exists (select 1 from <regions> r where r.chr = w.chr and w.pos >= r.start and w.pos < r."end")',
    "chrom_to_genome": f"select chr, pos, pos + start as linear from <bases> b join {_GENOME} g on g.chrom = b.chr",
    "genome_to_chrom": f"select pos + start as linear, chr, pos from <bases> b join {_GENOME} g on g.chrom = b.chr",
    "locus_order": f"select chr, pos, {_ORD.format('chr')} as ord, coalesce(({_ORD.format('chr')})::varchar, concat('raw:', chr)) as key from {_WHOLE} w",
    "order_check": "select chr, count(*) as n from (select chr, pos, lag(pos) over (partition by chr order by id) as before from (select chr, id, min(pos) as pos from <alignments> group by all)) where before >= pos group by chr",
    "ordered_merge": "select pos, sum(nA)::bigint as nA, sum(nC)::bigint as nC from <counts> group by pos",
    "positional_zip": "select seq_id as idx, length(seq)::int as n1, length(replace(seq, 'N', ''))::int as n2 from <seqs>",
    "tsv_map": 'select chr, start, "end", gene, "end" - start as len from <regions>',
    "rank_select": 'with v as (select distinct start * 7919 % 99991 * 1009 as v from <regions>) select q as query, (select count(*) from v where v < q)::bigint as rank from (select distinct "end" * 104729 % 99991 * 1009 as q from <regions>)',
    "scatter_round_robin": "select (seq_id % 7)::int as part, count(*) as n, sum(length(seq))::bigint as bases from <seqs> group by 1",
    "cigar_decode": "select cigar, i::int as i, op, len from (select cigar, unnest(regexp_extract_all(cigar, '([0-9]+)([MIDSH])', 2)) as op, unnest(regexp_extract_all(cigar, '([0-9]+)([MIDSH])', 1))::bigint as len, unnest(range(len(regexp_extract_all(cigar, '[MIDSH]')))) as i from (select distinct cigar from <alignments>))",
    "flag_predicates": "select flags, " + ", ".join(f"count(*) filter (flags & {1 << i} <> 0) as {n}" for i, n in enumerate(("paired", "proper_pair", "unmapped", "mate_unmapped", "reverse", "mate_reverse", "read_1", "read_2", "secondary", "qc_fail", "duplicate", "supplementary"))) + " from <alignments> group by flags",
    "revcomp": "select seq_id, md5(translate(reverse(seq), 'ACGT', 'TGCA')) as digest from <seqs>",
    "hamming": f"select a.seq_id, a.pos::int as pos, {_packed('a.kmer', 15)} as x, a.kmer, (select count(*) from range(1, 16) t(i) where substr(a.kmer, i::int, 1) <> substr(b.kmer, i::int, 1))::int as distance from {_kmers('reference', 15)} a join {_kmers('reference', 15)} b on b.seq_id = a.seq_id + 1 and a.pos = b.pos",
    "gc_entropy": "select seq_id, round(coalesce(-(select sum(n / length(s.seq)::double * log2(n / length(s.seq)::double)) from (select unnest([length(s.seq) - length(replace(s.seq, b, '')) for b in ['A', 'C', 'G', 'T', 'N']]) as n) where n > 0), 0), 6) as entropy from <seqs> s",
    "murmur_hash": f"select id, h as hash from {_murmur('id * 4294967311', 17, '(select distinct id from <alignments>)', 'id')} m",
    "hash_bias": f"select bit::int as bit, sum((h >> bit) & 1)::bigint as ones, count(*) as total, round((power(sum((h >> bit) & 1) - count(*) / 2.0, 2) + power(count(*) - sum((h >> bit) & 1) - count(*) / 2.0, 2)) / (count(*) / 2.0), 6) as chi2 from {_murmur('id * 4294967311', 17, '(select distinct id from <alignments>)', 'id')} m, range(32) t(bit) group by bit",
    "kmer_generate": f"select seq_id, pos::int as pos, kmer from {_kmers('reference', 9)} k",
    "kmer_positions": f"select seq_id, '+' as strand, pos::bigint as at, kmer from {_kmers('reference', 9, ', seq')} k union all select seq_id, '-', length(seq) - 9 - pos, {_rc('kmer')} from {_kmers('reference', 9, ', seq')} k",
    "kmer_canonical_hist": _hist(_CANON.format(rc=_rc("kmer"), src=_kmers("seqs", 11))),
    "kmer_sketch_hist": f"select n as multiplicity, count(*) as n_kmers from (select h, n from {_murmur(_packed('kmer', 25), 17, '(select kmer, count(*) as n from ' + _CANON.format(rc=_rc('kmer'), src=_kmers('seqs', 25)) + ' c group by kmer)', 'kmer, n')} m where h % 16 = 0) group by n",
    "kmer_both_strands_hist": _hist(f"(select kmer from {_kmers('seqs', 21)} a union all select {_rc('kmer')} from {_kmers('seqs', 21)} b)"),
    "kmer_label_unique": f"select label, count(*) as n from {_LABELS.format(_kmers('seqs', 25))} l group by label",
    "read_pair_labels": f"""select p.pair_id, coalesce(string_agg(distinct case when (mate = 1) = (strand = '+') then label end, ',' order by case when (mate = 1) = (strand = '+') then label end), '') as lhs, coalesce(string_agg(distinct case when (mate = 1) <> (strand = '+') then label end, ',' order by case when (mate = 1) <> (strand = '+') then label end), '') as rhs
        from <pairs> p left join (select pair_id, mate, strand, label from {_pair(25)} k join {_LABELS.format(_kmers('reference', 25))} l on l.kmer = k.kmer) h on h.pair_id = p.pair_id group by p.pair_id""",
    "kmer_pulldown": f"""select (select count(*) from <pairs>) as pairs, count(distinct pair_id) filter (mate = 1 and strand = '+') as "lhsFwd", count(distinct pair_id) filter (mate = 1 and strand = '-') as "lhsRev", count(distinct pair_id) filter (mate = 2 and strand = '+') as "rhsFwd", count(distinct pair_id) filter (mate = 2 and strand = '-') as "rhsRev"
        from {_pair(25)} k where kmer in (select kmer from {_murmur(_packed('kmer', 25), 17, '(select distinct kmer from ' + _kmers('reference', 25) + ' r)', 'kmer')} m where h % 4 = 0)""",
    "minhash_bottom_k": f"select kmer, h as hash from {_murmur(_packed('kmer', 8), 19, '(select distinct kmer from ' + _kmers('seqs', 8) + ' r)', 'kmer')} m order by h, kmer limit 100",
    "minhash_by_sequence": f"select seq_id, kmer, h as hash from {_murmur(_packed('kmer', 12), 19, '(select distinct seq_id, kmer from ' + _kmers('reference', 12) + ' r)', 'seq_id, kmer')} m qualify row_number() over (partition by seq_id order by h, kmer) <= 10",
    "allele_typing": "select locus, allele, count(*) as n from " + _pair(21) + " k join (select distinct locus, allele, kmer from (select locus, allele, substr(seq, pos::int + 1, 21) as kmer from (select *, unnest(range(0, length(seq) - 20)) as pos from <alleles>)) where regexp_full_match(kmer, '[ACGT]+')) a on a.kmer = k.kmer group by all",
    "positional_hits": f"select r.seq_id as read_id, s.seq_id, (s.pos - r.pos)::bigint as shift, count(*) as hits from {_kmers('reference', 25)} r join {_kmers('seqs', 25)} s on s.kmer = r.kmer group by all",
    "allele_runs": "select sample, min(pos) as first, max(pos) as last from (select sample, pos, pos - row_number() over (partition by sample order by pos) as g from (select distinct sample, pos from <counts>)) group by sample, g",
    "hgvsg_parse": f"select * from {_PARSED} p",
    "hgvsg_format": "select id, regexp_replace(regexp_replace(text, 'dupA$', 'dup'), 'delACGTA$', 'del') as text from <descriptions>",
    "hgvs_grammar": f"select id, 'g' as system, kind, first::varchar as first, last::varchar as last, alt from {_PARSED} p",
    "vcf_to_hgvsg": """select id, kind, first, last, concat(chr, ':g.', case when kind = 'sub' then concat(first, ref, '>', alt) else concat(case when first = last then first::varchar else concat(first, '_', last) end, kind, d) end) as text from (
        select id, chr, ref, alt, kind, first, last, d from (select id, chr, pos, ref, unnest(string_split(alt, ',')) as alt from <alleles_vcf>) a join (values ('A', 'G', 'sub', 0, 0, ''), ('C', 'CTT', 'ins', 0, 1, 'TT'), ('C', 'T', 'sub', 0, 0, ''), ('GATTA', 'G', 'del', 1, 4, ''), ('ACGT', 'ATT', 'delins', 1, 3, 'TT'), ('CCATG', 'CATGG', 'inv', 0, 0, ''), ('GAA', 'GTT', 'inv', 1, 2, ''), ('T', 'C', 'sub', 0, 0, ''), ('T', 'G', 'sub', 0, 0, '')) k(ref, alt, kind, o1, o2, d) using (ref, alt), lateral (select pos + o1 as first, pos + o2 as last) where not (ref = 'CCATG')
        union all select id, chr, ref, alt, 'delins', pos + 1, pos + 4, 'ATGG' from <alleles_vcf> where ref = 'CCATG')""",
    "transcript_overlap": 'select b.chr, pos + 999 as pos0, accession from <bases> b join <transcripts> t on t.chr = b.chr and pos + 999 < "txEnd" + 250 and "txStart" - 250 < pos + 1000',
    "info_parse": "select split_part(p, '=', 1) as key, count(*) as rows_with, sum(split_part(p, '=', 2)::bigint)::bigint as total from (select unnest(string_split(indels, ';')) as p from <counts>) where p <> '' group by 1",
    "kv_list_roundtrip": "select sample, count(*) as same, count(*) as n from <counts> group by sample",
    "sequence_slices": "select seq_id as acc, (length(seq) // 3)::bigint as begin, floor(length(seq) / 3.0 + 200)::bigint as \"end\", substr(seq, (length(seq) // 3 + 1)::int, (floor(length(seq) / 3.0 + 200) - length(seq) // 3)::int) as bases from <seqs>",
    "human_numbers": "select sample, sum(nA * 100)::bigint as n, case when sum(nA * 100) >= 1000000000 then printf('%.2fG', sum(nA * 100) / 1e9) when sum(nA * 100) >= 1000000 then printf('%.2fM', sum(nA * 100) / 1e6) when sum(nA * 100) >= 1000 then printf('%.2fK', sum(nA * 100) / 1e3) else printf('%.2f', sum(nA * 100)::double) end as text from <counts> group by sample",
    "stream_counts_merge": f"select chr, pos, {', '.join(_COUNTS)} from {_WHOLE} w",
    "stream_gamma_fit": f"select chr, pos, n, round(sx, 6) as sx, round(slx, 6) as slx, round(sxlx, 6) as sxlx from {_STATS} f",
}
# Greedy from the left: each occurrence taken leads to the next one that is far enough. Only k-mers found twice in a
# sequence need it; the others are taken once each.
SQL["kmer_nonoverlap"] = f"""
with found as materialized (select seq_id, kmer, pos from {_kmers('seqs', 20)} k), many as (select seq_id, kmer, list(pos order by pos) as l from found group by all having count(*) > 1),
taken(seq_id, kmer, l, last, n) as (select seq_id, kmer, l, l[1], 1 from many union all select seq_id, kmer, l, list_filter(l, lambda p: p >= last + 20)[1], n + 1 from taken where len(list_filter(l, lambda p: p >= last + 20)) > 0)
select kmer, sum(n)::bigint as n from (select kmer, max(n) as n from taken group by seq_id, kmer union all select kmer, 1 from found group by seq_id, kmer having count(*) = 1) group by kmer having sum(n) > 1
"""
SQL["allele_json"] = f"""select concat('{{', string_agg(concat('"', locus, '":{{', alleles, '}}'), ',' order by locus), '}}') as json from (select locus, string_agg(concat('"', allele, '":', n), ',' order by allele) as alleles from ({SQL['allele_typing']}) group by locus)"""
# The upper tail for odd degrees of freedom, 63, by its finite sum.
SQL["hash_bins"] = f"""select total, round(chi2, 6) as chi2, round(1 - list_sum(list_transform(range(0, 400), lambda i: exp(-chi2 / 2 + (31.5 + i) * ln(chi2 / 2) - lgamma(32.5 + i)))), 4) as p from (select sum(n)::bigint as total, sum(n * n) * 64.0 / sum(n) - sum(n) as chi2 from (select h % 64 as b, count(*) as n from {_murmur('id * 4294967311', 17, '(select distinct id from <alignments>)', 'id')} m group by 1))"""
SQL["vbyte_code"] = "select pos, array_to_string(list_transform(range(g), lambda i: ((x >> (7 * (g - 1 - i))) & 127) * 2 + case when i < g - 1 then 1 else 0 end), ',') as code, x as back from (select pos, pos * pos * 9973 as x, ((length(bin(pos * pos * 9973)) + 6) // 7)::bigint as g from <bases>)"
SQL["locus_parse"] = "select concat(chr, ':', pos) as text, chr, pos from <bases>"
SQL["gamma_moments"] = "select sample, round(avg(nA) * avg(nA) / var_pop(nA), 6) as k, round(var_pop(nA) / avg(nA), 6) as theta from <counts> group by sample"
_SHARE = " + ".join(f"case when {c} = 0 then 0 else {c}::double / t * ln(4.0 * {c} / t) end" for c in ("nA", "nC", "nG", "nT"))
SQL["base_divergence"] = f"select sample, chr, pos, round({_SHARE}, 6) as divergence from (select *, nA + nC + nG + nT as t from <counts>) where t > 0"
_CALLED = f"""(select w.chr, w.pos, ref, 0.002 / (1 + nA) as pval, nA+nC+nG+nT as dp, unnest(['A', 'C', 'G', 'T']) as alt, unnest([nA, nC, nG, nT]) as ac from {_NAMED} w join <bases> b on b.chr = w.chr and b.pos = w.pos)"""
_PASSED = f"(select * from {_CALLED} c where dp >= 100 and ac >= 3 and alt <> ref and pval <= 1e-4)"
SQL["call_variants"] = f"select chr, pos, ref, alt, round(-10 * log10(pval), 4) as qual, ac, round(ac::double / dp, 6) as af, dp, concat(chr, ':g.', pos, ref, '>', alt) as hgvsg from {_PASSED} p"
SQL["vcf_lines"] = f"""select chr, pos, alt, concat_ws(chr(9), chr, pos, '.', ref, alt, printf('%.2f', -10 * log10(pval)), 'PASS', printf('AC=%d;AF=%.2f;DP=%d;KLD=0.50;PVAL=', ac, ac::double / dp, dp)
    || case when strlen(printf('%.2g', pval)) < 2 then ' ' else '' end || printf('%.2g', pval) || concat(';HGVSg=', chr, ':g.', pos, ref, '>', alt)) as line from {_PASSED} p"""
SQL["annot_exac"] = SQL["annot_loci"].replace("select chr, pos, nA, cov, ref, split_part(alt, ' ', 2) as alt, round(own::double / cov, 6) as raf, round(split_part(alt, ' ', 1)::double / cov, 6) as vaf, round(pval, 6) as pval, '' as exac from (",
    "select chr, pos, split_part(alt, ' ', 2) as alt, case when split_part(alt, ' ', 2) = translate(ref, 'ACGT', 'CGTA') then (pos % 100)::varchar else '' end as exac from (").replace("pval <= 0.05", "true")
SQL["reference_bases"] = "select seq_id::varchar as chr, p::bigint as pos, substr(seq, p, 1) as ref from (select distinct seq_id, seq, unnest([1, 128, 129, length(seq) // 2, length(seq)]) as p from <seqs>) where p between 1 and length(seq)"
SQL["rope_functions"] = """select seq_id, md5(w) as whole, substr(w, greatest(a - 3, 0) + 1, a + 5 - greatest(a - 3, 0)) as slice, substr(w, 1, a) as head, (length(w) - a)::int as rest, length(seq)::int as mark, length(w)::int as "none"
    from (select seq_id, seq, concat(seq, '-', reverse(seq)) as w, length(seq) // 3 as a from <reference>)"""
SQL["sql_functions"] = """select seq_id, pos, translate(reverse(k), 'ACGT', 'TGCA') as revcomp, least(k, translate(reverse(k), 'ACGT', 'TGCA')) as canonical_kmer,
    list_sum(list_transform(range(11), lambda i: (strpos('ACGT', substr(k, (i + 1)::int, 1)) - 1) * 4 ** (10 - i)))::bigint as kmer_pack, length(regexp_replace(k, '[^GC]', '', 'g')) / 11.0 as gc_fraction, k as back, k as info
    from (select seq_id, p::int as pos, substr(seq, p + 1, 11) as k from (select seq_id, seq, unnest(range(length(seq) - 10)) as p from <reference>)) where k not like '%N%'"""
SQL["tsv_roundtrip"] = f"select w.chr, w.pos, {', '.join('w.' + c for c in _COUNTS)}, i.indels from ({SQL['counts_merge']}) w join ({SQL['counts_merge_indels']}) i on i.chr = w.chr and i.pos = w.pos"
SQL["stream_counts_indels"] = SQL["counts_merge_indels"]
SQL["bed_roundtrip"] = SQL["intervals_saved"] = 'select chr, start, "end", gene from <regions>'
SQL["sam_read"] = "select concat('read', id) as name, flags, chr, pos, cigar, tlen, seq, '*' as qual from <alignments>"
SQL["fastq_roundtrip"] = "select concat('r', seq_id) as id, md5(seq) as seq, length(seq)::int as n from <seqs> where length(seq) > 0"
SQL["fasta_read"] = "select concat('s', seq_id, ' some words') as name, md5(seq) as seq from <reference>"
SQL["vcf_roundtrip"] = f"select chr, pos, ref, alt, round(-10 * log10(pval), 2) as qual, 'PASS' as filter, printf('AC=%d;DP=%d', ac, dp) as info from {_PASSED} p"
SQL["gff3_read"] = 'select id, parent, type, chr, start, "end" from <features>'
SQL["refgene_read"] = 'select accession as name, chr as chrom, strand, "txStart", "txEnd", 3::int as n_exons, "txStart" + 90 as last_base from <transcripts>'

# The hash step by step, in numbers twice as wide: products leave a remainder, rotations are a product and a quotient.
_TWO = "(1::uhugeint << {0})"


def _hash_rounds(name: str, word: str, source: str) -> str:
    """A select of ``source`` with ``name`` hashed on by a word."""
    sql = f"select * exclude ({name}), xor({name}, {word}) as {name} from {source}"
    for x, left, right in ROUNDS:
        sql = f"select * exclude ({name}), ({name}::uhugeint * {x}::uhugeint) % {_TWO.format(64)} as {name} from ({sql})"
        for up in (left, 64 - right):
            sql = f"select * exclude ({name}), xor({name}, ({name} * {_TWO.format(up)}) % {_TWO.format(64)} + {name} // {_TWO.format(64 - up)}) as {name} from ({sql})"
    return sql


_SIGNED = "case when {0} >= (1::uhugeint << 63) then ({0}::hugeint - (1::hugeint << 64))::bigint else {0}::bigint end"
_BYTES = "list_sum(list_transform(range(length({0})), lambda i: ascii(substr({0}, (i + 1)::int, 1))::hugeint * (1::hugeint << (8 * (length({0}) - 1 - i))::int)))::uhugeint"
_READS = "(select distinct id, id::uhugeint as x, 17::uhugeint as h, 17::uhugeint as g, concat('read', id) as t from <alignments>)"
_HASHED = _hash_rounds("h", "x", f"({_hash_rounds('g', _BYTES.format('substr(t, 1, 8)'), _READS)})")
SQL["xlr_hash"] = f"""select id, {_SIGNED.format('h')} as hash, case when length(t) > 8 then {_SIGNED.format('g2')} else {_SIGNED.format('g')} end as text_hash
    from (select * from ({_HASHED}) join (select id as id2, g as g2 from ({_hash_rounds('g', _BYTES.format("concat(substr(t, 9), '')"), f'({_HASHED})')})) on id2 = id)"""

# A transcript of three exons, base by base: where it stands, spliced, and the intron bases by their nearer exon.
_TX = f"""(select accession, chr, strand, "txStart" as t0, g, zone0, i from <transcripts>, (select g, case when e then 'EXON' else 'OUT' end as zone0, sum(case when e then 1 else 0 end) over (order by g) - 1 as i from (select g, {' or '.join(f'g between {a} and {b - 1}' for a, b in _EX)} as e from range(-300, 400) t(g))))"""
SQL["hgvsc_map"] = f"""
with near as (select b.chr, b.pos + 1000 as pos, ref, translate(ref, 'ACGT', 'CATG') as alt, accession, strand, b.pos + 999 - "txStart" as g from <bases> b join <transcripts> t on t.chr = b.chr and b.pos + 999 < "txEnd" + 250 and "txStart" - 250 < b.pos + 1000),
spliced(g, x) as (select g, case {' '.join(f'when g between {a} and {b - 1} then g - {a - sum(d - c for c, d in _EX[:n])}' for n, (a, b) in enumerate(_EX))} when g < 0 then g when g >= 90 then g - 30 end from range(-300, 400) t(g)),
anchor(g, h) as (select g, case when g between 30 and 44 then case when g - 29 < 45 - g then 29 else 45 end when g between 60 and 74 then case when g - 59 < 75 - g then 59 else 75 end else g end from range(-300, 400) t(g)),
placed as (select n.*, a.h, case when strand = '+' then s.x - 15 else (select x from spliced where g = 59) + 0 - s.x end as i from near n join anchor a on a.g = n.g join spliced s on s.g = a.h),
zoned as (select *, case when strand = '+' then n_coding else n_coding end as c from (select *, 30 as n_coding from placed))
select chr, pos, ref, alt, accession, zone, place::bigint as place, rel::bigint as rel, concat(accession, ':c.', case when zone = 'UTR3' then '*' else '' end, place, case when zone = 'CODING' then '' when rel < 0 then rel::varchar when rel > 0 or zone = 'INTRON' then concat('+', rel) else '' end, case when strand = '-' then translate(ref, 'ACGT', 'TGCA') else ref end, '>', case when strand = '-' then translate(alt, 'ACGT', 'TGCA') else alt end) as hgvsc
from (select *, case when g <> h and g >= 15 and g < 70 then 'INTRON' when g <> h then case when (strand = '+') = (g < 15) then 'UTR5' else 'UTR3' end when i < 0 then 'UTR5' when i >= c then 'UTR3' else 'CODING' end as zone,
    case when i < 0 then i when i >= c then i - c + 1 else i + 1 end as place, case when strand = '+' then g - h else h - g end as rel from zoned)
"""


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in SQL.items() if sql}
