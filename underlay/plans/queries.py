"""One query an operator on derived records, and the same result in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import brackets, characters, geometry, intervals, metadata, revisions, rollup, sheets, slides, survey
from ..operators.findings import union
from ..sources.shared import shared_path
from . import carriers as C
from . import detectors
from . import packages as P

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
BASE = ("file_id", "basis", "human_sees", "machine_reads")


def register(name: str, oracle: str | None, *tables: str, packed: bool = False):
    """A query over the named derived tables, which the oracle's WITH names too; packed: in rows of many glyphs or readings."""

    def wrap(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*(C.load(spark, sf_dir, C.STANDS_FOR.get(t, t) if packed else t) for t in tables))

        run.__doc__ = f.__doc__
        QUERIES[name] = run
        if oracle is not None:
            text, more = oracle.strip(), [t for t in tables if t not in C.TABLES]
            ORACLE[name] = oracle if name == "page_detectors" else f"{C.with_clause(*more)}{',' if text.startswith('+') else ''}\n{text.lstrip('+')}" if more else text.lstrip("+").strip() if not text.startswith("+") else "WITH " + text.lstrip("+").strip()
        return f

    return wrap


def _count(n: str, word: str) -> str:
    """SQL of a number with its noun."""
    return f"({n}) || ' {word}' || CASE WHEN ({n}) = 1 THEN '' ELSE 's' END"


def shown(df: DataFrame, *more: str) -> DataFrame:
    more = (*more, *(() if "summary" in more else ("summary",)))
    codes = [F.array_join("codepoints", " ").alias("codepoints")] if "codepoints" in more else []
    return df.select(*BASE, *(c for c in more if c != "codepoints"), *codes)


# Characters


@register(
    "char_zero_width",
    f"""+ l AS (SELECT file_id, generate_subscripts(string_split(text, chr(10)), 1) AS line, unnest(string_split(text, chr(10))) AS body FROM units_zero_width),
c AS (SELECT file_id, line, body, unnest(range(1, length(body) + 1)) AS pos FROM l WHERE contains(body, '{C.ZWSP}')),
h AS (SELECT file_id, line, body, pos, pos - row_number() OVER (PARTITION BY file_id, line ORDER BY pos) AS g FROM c WHERE substr(body, pos, 1) = '{C.ZWSP}')
SELECT file_id, 'direct' AS basis, replace(body, '{C.ZWSP}', '') AS human_sees, replace(body, '{C.ZWSP}', '⟨U+200B⟩') AS machine_reads,
  CASE WHEN count(*) = 1 THEN 'ZERO WIDTH SPACE (U+200B), which a reader cannot see' ELSE count(*) || ' characters a reader cannot see: ZERO WIDTH SPACE' END AS summary,
  line::INT AS line, min(pos)::INT AS "column", string_agg('U+200B', ' ') AS codepoints FROM h GROUP BY file_id, line, body, g""",
    "units_zero_width",
)
def char_zero_width(units: DataFrame) -> DataFrame:
    return shown(characters.zero_width(units), "line", "column", "codepoints")


@register(
    "char_bidi",
    f"""SELECT doc_id::VARCHAR AS file_id, 'direct' AS basis, CASE WHEN doc_id % 2 = 0 THEN concat(a, reverse(b), c) ELSE concat(a, reverse(concat(b, c))) END AS human_sees,
  concat(a, '⟨U+202E⟩', b, CASE WHEN doc_id % 2 = 0 THEN '⟨U+202C⟩' ELSE '' END, c) AS machine_reads, 1 AS line,
  (length(a) + 1 + k * (length(b) + 1))::INT AS "column", CASE k WHEN 0 THEN 'U+202E' ELSE 'U+202C' END AS codepoints,
  CASE k WHEN 0 THEN 'RIGHT-TO-LEFT OVERRIDE (U+202E)' || CASE WHEN doc_id % 2 = 1 THEN ', never closed before the text ends' ELSE '' END ELSE 'POP DIRECTIONAL FORMATTING (U+202C)' END AS summary
FROM bidi_parts, (SELECT unnest([0, 1]) AS k) WHERE (k = 0 OR doc_id % 2 = 0) AND length(b) > 0
UNION ALL SELECT doc_id::VARCHAR, 'direct', concat(a, c), concat(a, '⟨U+202E⟩⟨U+202C⟩', c), 1, (length(a) + 1)::INT, 'U+202E U+202C', 'RIGHT-TO-LEFT OVERRIDE, POP DIRECTIONAL FORMATTING (U+202E, U+202C)' FROM bidi_parts WHERE length(b) = 0 AND doc_id % 2 = 0
UNION ALL SELECT doc_id::VARCHAR, 'direct', concat(a, reverse(c)), concat(a, '⟨U+202E⟩', c), 1, (length(a) + 1)::INT, 'U+202E', 'RIGHT-TO-LEFT OVERRIDE (U+202E), never closed before the text ends' FROM bidi_parts WHERE length(b) = 0 AND doc_id % 2 = 1""",
    "units_bidi",
)
def char_bidi(units: DataFrame) -> DataFrame:
    return shown(characters.bidi_control(units), "line", "column", "codepoints")


@register(
    "char_bidi_unclosed",
    "SELECT doc_id::VARCHAR AS file_id, length(a)::INT AS pos FROM bidi_parts WHERE doc_id % 2 = 1",
    "units_bidi",
)
def char_bidi_unclosed(units: DataFrame) -> DataFrame:
    return brackets.controls(units).where("open").select("file_id", "pos")


@register(
    "char_tags",
    f"""SELECT doc_id::VARCHAR AS file_id, 'direct' AS basis, line AS human_sees, concat(substr(line, 1, 10), '⟨tag characters: SECRET⟩', substr(line, 11)) AS machine_reads,
  1 AS line, (least(length(line), 10) + 1)::INT AS "column", '{" ".join(f"U+{ord(c):04X}" for c in C.SECRET)}' AS codepoints, 'SECRET' AS decoded, '6 tag characters that no renderer draws' AS summary FROM (SELECT doc_id, split_part(text, chr(10), 1) AS line FROM documents)""",
    "units_tags",
)
def char_tags(units: DataFrame) -> DataFrame:
    return shown(characters.tag_characters(units), "line", "column", "codepoints", "decoded")


@register(
    "char_mixed_script",
    f"""SELECT doc_id::VARCHAR AS file_id, 'circumstantial' AS basis, concat(z, 'p{C.CYRILLIC_A}ypal ', line) AS human_sees, concat(z, 'p⟨U+0430 Cyrillic⟩ypal ', line) AS machine_reads,
  1 AS line, (length(z) + 2)::INT AS "column", 'U+0430' AS codepoints, 'one word, "p{C.CYRILLIC_A}ypal", mixes Cyrillic and Latin' AS summary FROM (SELECT doc_id, repeat('z ', (doc_id % 7)::INT) AS z, split_part(text, chr(10), 1) AS line FROM documents)""",
    "units_mixed",
)
def char_mixed_script(units: DataFrame) -> DataFrame:
    return shown(characters.mixed_script(units), "line", "column", "codepoints")


@register("char_raw_silence", "SELECT doc_id::VARCHAR AS file_id, '' AS detector FROM documents WHERE regexp_matches(text, '[\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{2069}\\x{FEFF}\\x{E0000}-\\x{E007F}]')", "units")
def char_raw_silence(units: DataFrame) -> DataFrame:
    """The driver's texts hold nothing of the kind: no row."""
    return union(characters.detect(units)).select("file_id", "detector")


# Workbooks

_NOT_BLANK = "length(trim(text)) > 0"


@register(
    "sheet_hidden",
    f"""SELECT c.file_id, 'direct' AS basis, '' AS human_sees, string_agg(text, ' | ' ORDER BY cell_no) AS machine_reads, sheet_no,
  'sheet "' || any_value(name) || '" is marked ' || CASE any_value(hidden) WHEN 'very hidden' THEN 'very hidden, which the application itself cannot undo' ELSE 'hidden' END || ', and the file still holds its ' || {_count("count(*)", "value")} AS summary FROM cells c JOIN sheets s USING (file_id, sheet_no)
WHERE hidden IS NOT NULL AND {_NOT_BLANK} GROUP BY c.file_id, sheet_no""",
    "sheets",
    "cells",
)
def sheet_hidden(s: DataFrame, c: DataFrame) -> DataFrame:
    return sheets.hidden_sheets(s, c).select(*BASE, "summary", F.col("emit_seq").alias("sheet_no"))


def _axis_oracle(axis: str, place: str, basis: str, noun: str = "row", how: str = "hidden") -> str:
    name = "chr((64 + {0})::INT)" if noun == "column" else "{0}"
    first, last = name.format("any_value(lo)"), name.format("any_value(hi)")
    where = f"CASE WHEN any_value(lo) = any_value(hi) THEN '{noun} ' || {first} ELSE '{noun}s ' || {first} || ' to ' || {last} END || ' of sheet \"' || any_value(name) || '\" ' || CASE WHEN any_value(lo) = any_value(hi) THEN 'is' ELSE 'are' END"
    return f"""+ i AS (SELECT DISTINCT h.file_id, h.sheet_no, idx, name FROM hidden_axis h JOIN sheets s USING (file_id, sheet_no) WHERE {axis} AND hidden IS NULL),
g AS (SELECT *, idx - row_number() OVER (PARTITION BY file_id, sheet_no ORDER BY idx) AS island FROM i),
e AS (SELECT *, min(idx) OVER (PARTITION BY file_id, sheet_no, island) AS lo, max(idx) OVER (PARTITION BY file_id, sheet_no, island) AS hi FROM g)
SELECT e.file_id, '{basis}' AS basis, '' AS human_sees, string_agg(text, ' | ' ORDER BY idx, cell_no) AS machine_reads, {where} || ' {how}, and the file still holds ' || {_count("count(*)", "value")} || ' there' AS summary
FROM e JOIN cells c ON c.file_id = e.file_id AND c.sheet_no = e.sheet_no AND c.{place} = e.idx WHERE {_NOT_BLANK} GROUP BY e.file_id, e.sheet_no, island"""


@register("sheet_hidden_rows", _axis_oracle("axis = 'row'", "row", "direct"), "sheets", "cells", "hidden_axis")
def sheet_hidden_rows(s: DataFrame, c: DataFrame, a: DataFrame) -> DataFrame:
    return shown(sheets.hidden_rows(s, c, a))


@register("sheet_hidden_columns", _axis_oracle("axis = 'column'", "col", "direct", "column"), "sheets", "cells", "hidden_axis")
def sheet_hidden_columns(s: DataFrame, c: DataFrame, a: DataFrame) -> DataFrame:
    return shown(sheets.hidden_columns(s, c, a))


@register("sheet_filtered_rows", _axis_oracle("axis = 'filter' AND (h.file_id, h.sheet_no, idx) NOT IN (SELECT (file_id, sheet_no, idx) FROM hidden_axis WHERE axis = 'row')", "row", "circumstantial", how="held back by a filter that the file does not show"), "sheets", "cells", "hidden_axis")
def sheet_filtered_rows(s: DataFrame, c: DataFrame, a: DataFrame) -> DataFrame:
    return shown(sheets.filtered_rows(s, c, a))


@register(
    "sheet_changed_cell",
    """+ now AS (SELECT c.file_id, name, row, col, arg_min(text, cell_no) AS text FROM cells c JOIN sheets s USING (file_id, sheet_no) GROUP BY c.file_id, name, row, col)
SELECT h.file_id, 'direct' AS basis, coalesce(text, '') AS human_sees, previous AS machine_reads,
 'cell A' || h.row || ' of sheet "' || h.sheet || '" was changed by ' || coalesce(author, 'somebody the file does not name') || ', at a time the file does not give; the file still holds the earlier value' AS summary FROM cell_changes h LEFT JOIN now ON h.file_id = now.file_id AND h.sheet = now.name AND h.row = now.row AND h.col = now.col
WHERE length(trim(previous)) > 0""",
    "sheets",
    "cells",
    "cell_changes",
)
def sheet_changed_cell(s: DataFrame, c: DataFrame, h: DataFrame) -> DataFrame:
    return shown(sheets.changed_cells(s, c, h))


@register(
    "sheet_visible_text",
    """+ v AS (SELECT c.* FROM cells c JOIN sheets s USING (file_id, sheet_no) WHERE hidden IS NULL AND (c.sheet_no, c.row) NOT IN (SELECT (sheet_no, idx) FROM hidden_axis WHERE axis <> 'column') AND (c.sheet_no, c.col) NOT IN (SELECT (sheet_no, idx) FROM hidden_axis WHERE axis = 'column')),
r AS (SELECT file_id, sheet_no, row, string_agg(text, chr(9) ORDER BY cell_no) AS t FROM v GROUP BY ALL)
SELECT file_id, sheet_no, string_agg(t, chr(10) ORDER BY row) AS text FROM r GROUP BY ALL""",
    "sheets",
    "cells",
    "hidden_axis",
)
def sheet_visible_text(s: DataFrame, c: DataFrame, a: DataFrame) -> DataFrame:
    return sheets.visible_text(s, c, a).select("file_id", "sheet_no", "text")


# Decks


@register(
    "slide_hidden",
    f"""SELECT file_id, 'direct' AS basis, '' AS human_sees, said AS machine_reads, number, 'slide ' || number || ' is marked hidden and skipped in a show; the file still holds its ' || {_count("length(said)", "character")} AS summary
FROM (SELECT *, concat_ws('  ', nullif(text, ''), nullif(trim(notes), '')) AS said FROM slides) WHERE hidden AND (text <> '' OR trim(notes) <> '')""",
    "slides",
)
def slide_hidden(s: DataFrame) -> DataFrame:
    return slides.hidden_slides(s).select(*BASE, "summary", F.col("emit_seq").alias("number"))


@register("slide_notes", "SELECT file_id, 'direct' AS basis, '' AS human_sees, notes AS machine_reads, 'slide ' || number || ' has a speaker note, which is in the file and on no screen' AS summary FROM slides WHERE NOT hidden AND trim(notes) <> ''", "slides")
def slide_notes(s: DataFrame) -> DataFrame:
    return shown(slides.speaker_notes(s))


@register("slide_visible_text", "SELECT file_id, number AS page, text FROM slides WHERE NOT hidden AND trim(text) <> ''", "slides")
def slide_visible_text(s: DataFrame) -> DataFrame:
    return slides.visible_text(s).select("file_id", "page", "text")


# Revisions, attachments


_BY = "coalesce(nullif(author, ''), 'an author the file does not give') || coalesce(' on ' || nullif(date, ''), ', at a time the file does not give')"


@register("rev_deleted_text", f"SELECT file_id, 'direct' AS basis, '' AS human_sees, text AS machine_reads, seq, {_count('length(text)', 'character')} || CASE kind WHEN 'deletion' THEN ' deleted by ' ELSE ' moved away by ' END || {_BY} || '; the file still holds the text' AS summary FROM revisions WHERE kind IN ('deletion', 'move-from') AND trim(text) <> ''", "revisions")
def rev_deleted_text(r: DataFrame) -> DataFrame:
    return revisions.deleted_text(r).select(*BASE, "summary", F.col("emit_seq").alias("seq"))


@register("rev_comment", f"SELECT file_id, 'direct' AS basis, '' AS human_sees, text AS machine_reads, 'a comment by ' || {_BY} || ', in the file and not in the document''s body' AS summary FROM comments WHERE trim(text) <> ''", "comments")
def rev_comment(c: DataFrame) -> DataFrame:
    return shown(revisions.comments(c))


@register(
    "rev_history",
    """+ b AS (SELECT file_id, 0 AS o, seq, kind, author, date FROM revisions UNION ALL SELECT file_id, 1, seq, 'comment', author, date FROM comments),
k AS (SELECT file_id, string_agg(n || ' ' || kind || CASE WHEN n = 1 THEN '' ELSE 's' END, ', ' ORDER BY kind) AS tally FROM (SELECT file_id, kind, count(*) AS n FROM b GROUP BY ALL) GROUP BY file_id),
a AS (SELECT file_id, author, min((o, seq)) AS spot FROM b WHERE author <> '' GROUP BY ALL),
p AS (SELECT file_id, string_agg(author, ', ' ORDER BY spot) AS people, count(*) AS n FROM a GROUP BY file_id),
d AS (SELECT file_id, min(date) AS lo, max(date) AS hi FROM b WHERE date <> '' GROUP BY file_id)
SELECT file_id, 'self-reported' AS basis, '' AS human_sees, people AS machine_reads,
 'the file records changes by ' || n || CASE WHEN n = 1 THEN ' person: ' ELSE ' people: ' END || tally || CASE WHEN lo = hi THEN ', on ' || lo ELSE ', between ' || lo || ' and ' || hi END AS summary
FROM p JOIN k USING (file_id) JOIN d USING (file_id)""",
    "revisions",
    "comments",
)
def rev_history(r: DataFrame, c: DataFrame) -> DataFrame:
    return shown(revisions.revision_history(r, c), "summary")


@register("word_hidden", f"SELECT file_id, 'direct' AS basis, '' AS human_sees, text AS machine_reads, {_count('length(text)', 'character')} || ' with Word''s hidden attribute' || CASE part WHEN 'the document' THEN '' ELSE ', in ' || part END || '; no screen and no print shows them' AS summary FROM word_hidden", "word_hidden")
def word_hidden(h: DataFrame) -> DataFrame:
    return shown(revisions.word_hidden(h))


@register(
    "attach_file",
    f"""SELECT file_id, 'direct' AS basis, CASE WHEN part LIKE '/Names%' THEN '' ELSE 'a rendering of it' END AS human_sees, coalesce(text, description) AS machine_reads,
 'the document carries a file named "' || name || '" in ' || part || ', ' || {_count("size", "byte")} || ', ' || CASE WHEN part LIKE '/Names%' THEN 'on no page and in no print' ELSE 'of which the page shows a picture and not the file' END AS summary FROM attachments""",
    "attachments",
)
def attach_file(a: DataFrame) -> DataFrame:
    return shown(revisions.attached_files(a))


@register(
    "pdf_earlier_revision",
    f"""+ l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS spot FROM documents),
q AS (SELECT doc_id, spot, trim(regexp_replace(raw, '[ \\t\\r\\f\\v]+', ' ', 'g')) AS line FROM l),
now AS (SELECT DISTINCT doc_id, line FROM q WHERE spot % 3 <> 0)
SELECT doc_id::VARCHAR AS file_id, 'direct' AS basis, '' AS human_sees, string_agg(line, chr(10) ORDER BY spot) AS machine_reads,
 'the file holds 2 revisions of itself; revision 1 (' || {_count("doc_id % 3 + 1", "page")} || ', ending at byte ' || doc_id * 100 || ') still holds text that no page shows now' AS summary FROM q WHERE line <> '' AND (doc_id, line) NOT IN (SELECT (doc_id, line) FROM now) GROUP BY doc_id""",
    "documents",
    "earlier",
)
def pdf_earlier_revision(docs: DataFrame, earlier: DataFrame) -> DataFrame:
    every = F.filter(F.split("text", "\n", -1), lambda x, i: (i + 1) % 3 != 0)
    current = docs.select(F.col("doc_id").cast("string").alias("file_id"), F.lit("").alias("inside"), F.lit(0).alias("unit_no"), F.lit(None).cast("int").alias("page"), F.array_join(every, "\n").alias("text"))
    return shown(revisions.earlier_revisions(earlier, current))


# Metadata

_PATHLIKE = r"regexp_matches(v, '^(/[^/\s][^\s]*|[A-Za-z]:[\\/][^\s]*|\\\\[^\\\s]+\\[^\s]*)$')"


@register(
    "meta_undisclosed",
    f"""+ f AS (SELECT *, trim(value) AS v FROM meta_fields WHERE role = 'content')
SELECT f.file_id, 'self-reported' AS basis, '' AS human_sees, v AS machine_reads, 'field ' || name || ' of ' || part || ' holds a value that the document''s text shows nowhere' AS summary FROM f JOIN meta_units u USING (file_id) WHERE NOT {_PATHLIKE} AND (length(v) < 4 OR NOT contains(lower(u.text), lower(v)))""",
    "meta_fields",
    "meta_units",
)
def meta_undisclosed(f: DataFrame, u: DataFrame) -> DataFrame:
    return shown(metadata.undisclosed(f, u))


@register(
    "meta_undisclosed_lines",
    f"""+ f AS (SELECT *, trim(value, {" || ".join(f"chr({c})" for c in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 8232, 8233, 12288))}) AS v FROM line_fields)
SELECT f.file_id, 'self-reported' AS basis, '' AS human_sees, v AS machine_reads, 'field ' || name || ' of ' || part || ' holds a value that the document''s text shows nowhere' AS summary FROM f LEFT JOIN documents d ON d.doc_id::VARCHAR = f.file_id
WHERE v <> '' AND NOT {_PATHLIKE} AND (length(v) < 4 OR NOT contains(coalesce(lower(d.text), ''), lower(v)))""",
    "line_fields",
    "line_units",
)
def meta_undisclosed_lines(f: DataFrame, u: DataFrame) -> DataFrame:
    """Values that lie in one line of a document, across several, or in none."""
    return shown(metadata.undisclosed(f, u))


@register("meta_path", f"SELECT file_id, 'self-reported' AS basis, '' AS human_sees, v AS machine_reads, 'field ' || name || ' of ' || part || ' holds a file system path, which names folders and mostly an account' AS summary FROM (SELECT *, trim(value) AS v FROM meta_fields) WHERE role <> 'tool' AND {_PATHLIKE}", "meta_fields")
def meta_path(f: DataFrame) -> DataFrame:
    return shown(metadata.paths(f))


@register(
    "meta_conflict_time",
    """+ t AS (SELECT file_id, max(CASE WHEN name = 'CreationDate' THEN value END) AS made, max(CASE WHEN name = 'ModDate' THEN value END) AS changed FROM meta_fields GROUP BY file_id)
SELECT file_id, 'self-reported' AS basis, '' AS human_sees, 'ModDate ' || changed AS machine_reads, 'by its own account the file was modified at ' || changed || ' and created at ' || made || '; a clock, a time zone, a copy or an edit can do this' AS summary FROM t WHERE changed::TIMESTAMPTZ < made::TIMESTAMPTZ""",
    "meta_fields",
)
def meta_conflict_time(f: DataFrame) -> DataFrame:
    return shown(metadata.time_conflicts(f))


@register(
    "meta_conflict_copies",
    """SELECT a.file_id, 'self-reported' AS basis, '' AS human_sees, b.value AS machine_reads, 'the Info dictionary gives Author as "' || a.value || '", the XMP packet gives dc:creator as "' || b.value || '"; a tool that clears one of the two leaves this' AS summary FROM meta_fields a JOIN meta_fields b ON a.file_id = b.file_id AND a.name = 'Author' AND b.name = 'dc:creator' WHERE trim(a.value) <> trim(b.value)""",
    "meta_fields",
)
def meta_conflict_copies(f: DataFrame) -> DataFrame:
    return shown(metadata.copy_conflicts(f))


@register(
    "meta_history",
    """+ e AS (SELECT file_id, seq, software, action || coalesce(' by ' || software, '') || coalesce(' (changed ' || changed || ')', '') AS event FROM meta_history),
t AS (SELECT file_id, string_agg(software, ', ' ORDER BY spot) AS tools FROM (SELECT file_id, software, min(seq) AS spot FROM e WHERE software IS NOT NULL GROUP BY ALL) GROUP BY file_id)
SELECT file_id, 'self-reported' AS basis, '' AS human_sees, coalesce(any_value(tools), string_agg(event, '; ' ORDER BY seq)) AS machine_reads,
 'the XMP packet records ' || count(*) || ' event' || CASE WHEN count(*) = 1 THEN '' ELSE 's' END || ': ' || string_agg(event, '; ' ORDER BY seq) AS summary FROM e LEFT JOIN t USING (file_id) GROUP BY file_id""",
    "meta_history",
)
def meta_history(h: DataFrame) -> DataFrame:
    return shown(metadata.edit_trail(h), "summary")


@register(
    "meta_claims",
    """SELECT file_id, 'the file says it was made by ' || string_agg(name || ' ' || value, '; ' ORDER BY seq) FILTER (WHERE role = 'tool') || ', and dates itself ' || string_agg(name || ' ' || value, '; ' ORDER BY seq) FILTER (WHERE role = 'time') AS text FROM meta_fields GROUP BY file_id""",
    "meta_fields",
)
def meta_claims(f: DataFrame) -> DataFrame:
    return metadata.claims(f).select("file_id", "text")


@register("thumb_stale", "SELECT file_id, 'circumstantial' AS basis, 'a picture ' || w || 'x' || h AS human_sees, 'a preview ' || tw || 'x' || th || ', of something else' AS machine_reads, 'the picture is ' || w || 'x' || h || ' and the preview inside it ' || tw || 'x' || th || '; another shape, so it was made from another picture' AS summary FROM images WHERE th > 0 AND abs(w::DOUBLE / h - tw::DOUBLE / th) / (w::DOUBLE / h) > 0.02", "images")
def thumb_stale(i: DataFrame) -> DataFrame:
    return shown(metadata.stale_thumbnail(i))


# Pages

_PAINTED = "mode IN (0, 1, 2, 4, 5, 6) AND alpha > 0.01"


def _under_oracle(kind: str) -> str:
    """Glyphs are ten wide on a grid of ten, so a bar covers a glyph wholly or not at all."""
    return f"""+ s AS (SELECT s.*, CASE WHEN kind = 'image' THEN 'an image; a scan over its text layer looks the same' WHEN r IS NULL THEN 'a shape of unstated colour' WHEN r < 0.25 THEN 'a black shape' ELSE 'a white shape' END AS what, CASE WHEN kind = 'image' OR r IS NULL THEN '▒' WHEN r < 0.25 THEN '█' ELSE ' ' END AS block FROM shapes s JOIN drawn_pages p USING (file_id, page) WHERE kind = '{kind}' AND s.alpha >= 0.999 AND NOT (x1 - x0 >= (bx1 - bx0) * 0.9 AND y1 - y0 >= (by1 - by0) * 0.9)),
o AS (SELECT g.*, row_number() OVER (PARTITION BY file_id ORDER BY ox) AS n FROM glyphs g WHERE {_PAINTED}),
h AS (SELECT o.file_id, o.n, o.ch, block, what, o.n - row_number() OVER (PARTITION BY o.file_id ORDER BY o.n) AS island FROM o JOIN s ON o.file_id = s.file_id AND o.ord <= s.ord AND o.x0 >= s.x0 AND o.x1 <= s.x1),
c AS (SELECT file_id, any_value(block) AS block, any_value(what) AS what, trim(string_agg(ch, '' ORDER BY n)) AS said, min(n) FILTER (WHERE trim(ch) <> '') AS lo, max(n) FILTER (WHERE trim(ch) <> '') AS hi FROM h GROUP BY file_id, island),
l AS (SELECT c.file_id, lo, trim(regexp_replace(string_agg(ch, '' ORDER BY n) FILTER (WHERE n < lo OR n > hi), '\\s+', ' ', 'g')) AS rest FROM c JOIN o USING (file_id) GROUP BY c.file_id, lo)
SELECT c.file_id, 'direct' AS basis, repeat(block, length(said)) AS human_sees, said AS machine_reads,
 {_count("length(said)", "character")} || ' under ' || what || CASE WHEN coalesce(rest, '') = '' THEN '' ELSE '; the line goes on "' || rest || '"' END AS summary FROM c JOIN l ON c.file_id = l.file_id AND c.lo = l.lo WHERE said <> ''"""


@register("pdf_covered", _under_oracle("fill"), "glyphs", "shapes", "drawn_pages", packed=True)
def pdf_covered(g: DataFrame, s: DataFrame, p: DataFrame) -> DataFrame:
    return shown(geometry.covered_text(g, s, p))


@register("pdf_under_image", _under_oracle("image"), "glyphs", "shapes", "drawn_pages", packed=True)
def pdf_under_image(g: DataFrame, s: DataFrame, p: DataFrame) -> DataFrame:
    return shown(geometry.text_under_image(g, s, p))


@register("pdf_lines", "SELECT file_id, 0 AS angle, 100::BIGINT AS across, string_agg(ch, '' ORDER BY ox) AS text FROM glyphs GROUP BY file_id", "glyphs", packed=True)
def pdf_lines(g: DataFrame) -> DataFrame:
    return geometry.line_texts(g).select("file_id", "angle", "across", "text")


@register(
    "pdf_invisible",
    f"""+ w AS (SELECT file_id, ox, ch, CASE WHEN mode = 3 THEN 'direct' WHEN alpha <= 0.15 THEN 'circumstantial' END AS basis FROM glyphs)
SELECT file_id, basis, '' AS human_sees, string_agg(ch, '' ORDER BY ox) AS machine_reads,
 {_count("count(*)", "character")} || CASE basis WHEN 'direct' THEN ' drawn in render mode 3, which paints nothing' ELSE ' painted at opacity 0.1, which a reader may miss, and watermarks use' END AS summary FROM w WHERE basis IS NOT NULL GROUP BY file_id, basis HAVING trim(string_agg(ch, '' ORDER BY ox)) <> ''""",
    "glyphs",
)
def pdf_invisible(g: DataFrame) -> DataFrame:
    return shown(geometry.invisible_text(g))


@register(
    "pdf_low_contrast",
    f"""+ o AS (SELECT g.file_id, g.ch, g.fr, s.file_id IS NULL AS paper, CASE WHEN s.file_id IS NULL THEN 1.0 WHEN s.kind = 'image' THEN NULL ELSE s.r END AS back, row_number() OVER (PARTITION BY g.file_id ORDER BY g.ox) AS n
  FROM glyphs g LEFT JOIN shapes s ON g.file_id = s.file_id AND s.alpha >= 0.999 AND s.ord < g.ord AND g.x0 >= s.x0 AND g.x1 <= s.x1 WHERE g.mode IN (0, 1, 2, 4, 5, 6) AND g.alpha > 0.01),
h AS (SELECT *, n - row_number() OVER (PARTITION BY file_id ORDER BY n) AS island FROM o WHERE back IS NOT NULL AND abs(fr - back) <= 0.08)
SELECT file_id, 'direct' AS basis, '' AS human_sees, string_agg(ch, '' ORDER BY n) AS machine_reads, {_count("count(*)", "character")} || ' painted ' || CASE WHEN arg_min(fr, n) = 1 THEN '#ffffff on #ffffff' ELSE '#000000 on #000000' END || ', one colour; the background is '
 || CASE WHEN arg_min(paper, n) THEN 'the paper' ELSE 'a shape painted before' END AS summary FROM h GROUP BY file_id, island HAVING trim(string_agg(ch, '' ORDER BY n)) <> ''""",
    "glyphs",
    "shapes",
    packed=True,
)
def pdf_low_contrast(g: DataFrame, s: DataFrame) -> DataFrame:
    return shown(geometry.low_contrast_text(g, s))


@register(
    "pdf_off_page",
    f"""+ o AS (SELECT g.file_id, ox, ch, ox >= bx1 AS off FROM glyphs g JOIN drawn_pages p USING (file_id)),
r AS (SELECT file_id, string_agg(ch, '' ORDER BY ox) FILTER (WHERE off) AS text, bool_or(NOT off AND trim(ch) <> '') AS remains FROM o GROUP BY file_id)
SELECT file_id, CASE WHEN remains THEN 'circumstantial' ELSE 'direct' END AS basis, '' AS human_sees, text AS machine_reads,
 {_count("length(text)", "character")} || ' wholly outside the visible area' || CASE WHEN remains THEN '; the rest of the line is on the page, so it may be an overflow' ELSE '' END AS summary FROM r WHERE trim(text) <> ''""",
    "glyphs",
    "drawn_pages",
    packed=True,
)
def pdf_off_page(g: DataFrame, p: DataFrame) -> DataFrame:
    """A glyph that is a blank alone is a drawing operation of blanks; such glyphs do not count."""
    return shown(geometry.off_page_text(g.withColumn("run_no", F.lit(1)).withColumn("step_run", F.lit(0)), p))


@register("pdf_annotation_comment", "SELECT file_id, 'direct' AS basis, '' AS human_sees, contents AS machine_reads, 'a /' || subtype || ' annotation by ' || author || ', attached to the page and no part of it' AS summary FROM annotations WHERE subtype IN ('Text', 'Highlight') AND trim(contents) <> ''", "annotations")
def pdf_annotation_comment(a: DataFrame) -> DataFrame:
    return shown(geometry.annotation_comments(a))


@register(
    "pdf_words",
    """SELECT file_id, count(*) AS words, string_agg(w, ' ' ORDER BY i) AS text FROM (SELECT file_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM
 (SELECT file_id, list_filter(string_split(string_agg(CASE WHEN painted THEN ch ELSE ' ' END, '' ORDER BY ox), ' '), lambda x: x <> '') AS ws FROM (SELECT *, mode IN (0, 1, 2, 4, 5, 6) AND alpha > 0.01 AS painted FROM glyphs) GROUP BY file_id)) GROUP BY file_id""",
    "glyphs",
    packed=True,
)
def pdf_words(g: DataFrame) -> DataFrame:
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text"))), lambda w: w["text"]), " ")
    return geometry.words(g).groupBy("file_id").agg(F.count("*").alias("words"), listed.alias("text"))


_ALNUM = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


@register(
    "ocr_unrendered",
    f"""+ w AS (SELECT file_id, ox, ch, {_ALNUM.format("ch")} AS key FROM apart_glyphs WHERE {_PAINTED} AND {_ALNUM.format("ch")} <> ''),
n AS (SELECT w.file_id, w.ox, w.ch, row_number() OVER (PARTITION BY w.file_id ORDER BY w.ox) AS n, NOT contains(coalesce({_ALNUM.format("r.text")}, ''), key) AS lost FROM w LEFT JOIN ocr_words r ON r.file_id = w.file_id AND r.x0 = w.ox AND r.y0 < 110),
h AS (SELECT *, n - row_number() OVER (PARTITION BY file_id ORDER BY n) AS island FROM n WHERE lost)
SELECT file_id, 'circumstantial' AS basis, '' AS human_sees, string_agg(ch, ' ' ORDER BY n) AS machine_reads, count(*) || ' words in a row are in the file and were not read off a rendering of the page; a reader that fails looks the same' AS summary FROM h GROUP BY file_id, island HAVING count(*) >= 3""",
    "apart_glyphs",
    "ocr_words",
    packed=True,
)
def ocr_unrendered(g: DataFrame, o: DataFrame) -> DataFrame:
    return shown(geometry.unrendered_text(g, o))


@register(
    "ocr_unextractable",
    f"""+ o AS (SELECT r.* FROM ocr_words r LEFT JOIN apart_glyphs g ON g.file_id = r.file_id AND g.ox = r.x0 AND r.y0 < 110 AND trim(g.ch) <> '' WHERE g.file_id IS NULL AND conf >= 60 AND {_ALNUM.format("r.text")} <> '')
SELECT file_id, 'circumstantial' AS basis, string_agg(text, ' ' ORDER BY word_no) AS human_sees, '' AS machine_reads, count(*) || ' words were read off a rendering of the page with no text of the file under them; a scan without a text layer looks the same' AS summary FROM o GROUP BY file_id HAVING count(*) >= 3""",
    "apart_glyphs",
    "ocr_words",
    packed=True,
)
def ocr_unextractable(g: DataFrame, o: DataFrame) -> DataFrame:
    return shown(geometry.unextractable_text(g, o))


@register(
    "thumb_unseen_words",
    f"""+ a AS (SELECT file_id, word_no, text, {_ALNUM.format("text")} AS key FROM ocr_words WHERE conf >= 60 AND {_ALNUM.format("text")} <> '')
SELECT file_id, 'circumstantial' AS basis, '' AS human_sees, string_agg(text, ' ' ORDER BY word_no) AS machine_reads, count(*) || ' words can be read in the preview inside the file and not in the picture itself' AS summary FROM a WHERE word_no % 2 = 0 AND (file_id, key) NOT IN (SELECT (file_id, key) FROM a WHERE word_no % 2 = 1) GROUP BY file_id HAVING count(*) >= 2""",
    "ocr_words",
)
def thumb_unseen_words(o: DataFrame) -> DataFrame:
    return shown(geometry.unseen_words(o.where("word_no % 2 = 0"), o.where("word_no % 2 = 1")))


@register(
    "pdf_page_remarks",
    f"""+ n AS (SELECT file_id, 'page 1 has 1 annotation(s) with an appearance of their own, which was not interpreted' AS text FROM annotations WHERE has_appearance),
p AS (SELECT g.file_id, count(*) AS n FROM glyphs g JOIN shapes s ON g.file_id = s.file_id AND s.alpha >= 0.999 AND s.ord < g.ord AND g.x0 >= s.x0 AND g.x1 <= s.x1 AND s.kind = 'image' WHERE g.mode IN (0, 1, 2, 4, 5, 6) AND g.alpha > 0.01 AND trim(ch) <> '' GROUP BY g.file_id)
SELECT * FROM n UNION ALL SELECT file_id, 'page 1 has ' || n || ' character' || CASE WHEN n = 1 THEN '' ELSE 's' END || ' on a picture or a fill of unstated colour; whether they can be read was not established' FROM p""",
    "glyphs",
    "shapes",
    "annotations",
    packed=True,
)
def pdf_page_remarks(g: DataFrame, s: DataFrame, a: DataFrame) -> DataFrame:
    return geometry.remarks(g, s, a).select("file_id", "text")


def _ranked(detector: str, of: str, order: str = "lo") -> str:
    return f"SELECT '{detector}' AS detector, file_id, basis, human_sees, machine_reads, summary FROM ({ORACLE[of]})"


#: Off the page as in pdf_off_page, but by the drawing operations as they are: those that draw a blank alone do not count.
_OFF_RUNS = f"""{C.with_clause("glyphs", "drawn_pages")}, o AS (SELECT g.file_id, ox, ch, ox >= bx1 AS off FROM glyphs g JOIN drawn_pages p USING (file_id) WHERE trim(ch) <> ''),
r AS (SELECT file_id, string_agg(ch, '' ORDER BY ox) FILTER (WHERE off) AS text, bool_or(NOT off) AS remains FROM o GROUP BY file_id)
SELECT 'off-page-text' AS detector, file_id, CASE WHEN remains THEN 'circumstantial' ELSE 'direct' END AS basis, '' AS human_sees, text AS machine_reads,
 {_count("length(text)", "character")} || ' wholly outside the visible area' || CASE WHEN remains THEN '; the rest of the line is on the page, so it may be an overflow' ELSE '' END AS summary FROM r WHERE text IS NOT NULL"""


@register(
    "page_detectors",
    " UNION ALL ".join([*(_ranked(d, q) for d, q in (("covered-text", "pdf_covered"), ("text-under-image", "pdf_under_image"), ("invisible-text", "pdf_invisible"), ("low-contrast-text", "pdf_low_contrast"))), f"SELECT * FROM ({_OFF_RUNS})"]),
    "glyphs",
    "shapes",
    "drawn_pages",
    packed=True,
)
def page_detectors(g: DataFrame, s: DataFrame, p: DataFrame) -> DataFrame:
    """All detectors of text on pages, by their names in the registry: lines are exchanged, glyphs laid out where those lie, once for all."""
    names = [d.name for d in detectors.REGISTRY.values() if set(d.inputs) <= {"laid", "pages"}]
    return geometry.on_pages(geometry.lay(g, s), p, *names).select("detector", *BASE, "summary")


@register("shape_kinds", "SELECT kind, CASE WHEN alpha >= 0.999 THEN 'opaque' ELSE 'translucent' END AS paint, count(*) AS shapes, count(DISTINCT file_id) AS pages, sum((x1 - x0) * (y1 - y0)) AS area FROM shapes GROUP BY ALL", "shapes")
def shape_kinds(s: DataFrame) -> DataFrame:
    return survey.shape_kinds(s).groupBy("kind", "paint").agg(F.sum("shapes").alias("shapes"), F.count("*").alias("pages"), F.sum("area").alias("area"))


# Intervals

_DAYS = "datediff('day', DATE '1970-01-01', CAST({} AS DATE))"


@register(
    "interval_join",
    f"""+ a AS (SELECT l_suppkey AS k, l_linestatus AS m, {_DAYS.format("l_shipdate")} AS lo, {_DAYS.format("l_shipdate")} + l_linenumber * 3 AS hi FROM lineitem),
o AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY k, m ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM a),
g AS (SELECT *, sum(opens) OVER (PARTITION BY k, m ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS run FROM o),
r AS (SELECT k, m, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY k, m, run),
b AS (SELECT l_suppkey AS k, {_DAYS.format("l_shipdate")} + CAST(l_quantity AS BIGINT) % 7 AS lo, {_DAYS.format("l_shipdate")} + CAST(l_quantity AS BIGINT) AS hi FROM lineitem WHERE l_returnflag = 'R')
SELECT r.k AS supplier, m AS status, count(*) AS pairs, sum(least(r.hi, b.hi) - greatest(r.lo, b.lo))::BIGINT AS days, min(greatest(r.lo, b.lo))::BIGINT AS first FROM r JOIN b ON r.k = b.k AND r.lo < b.hi AND b.lo < r.hi WHERE b.lo < b.hi GROUP BY r.k, m""",
    "lineitem",
)
def interval_join(items: DataFrame) -> DataFrame:
    """Days on which a supplier ships lines of some status (runs merged), against the days after returned items."""
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1970-01-01").cast("date")).cast("long")
    amount = F.col("l_quantity").cast("long")
    runs = intervals.merged(items.select("l_suppkey", "l_linestatus", day.alias("lo"), (day + F.col("l_linenumber") * 3).alias("hi")), ["l_suppkey", "l_linestatus"])
    back = items.where("l_returnflag = 'R'").select("l_suppkey", (day + amount % 7).alias("lo"), (day + amount).alias("hi"))
    met = intervals.overlapping(runs, back, ["l_suppkey"])
    first, past = F.greatest("left.lo", "right.lo"), F.least("left.hi", "right.hi")
    return met.groupBy(F.col("left.l_suppkey").alias("supplier"), F.col("left.l_linestatus").alias("status")).agg(F.count("*").alias("pairs"), F.sum(past - first).alias("days"), F.min(first).alias("first"))


# Folders



@register(
    "survey_files_per_kind",
    """+ b AS (SELECT file_id, detector, count(*) AS n, min((line, emit_seq)) AS spot FROM survey_findings GROUP BY ALL)
SELECT detector, count(*) AS files, sum(n)::BIGINT AS findings, arg_min(rel_path, (string_split(rel_path, '/'), spot)) AS first FROM b JOIN survey_files USING (file_id) GROUP BY detector""",
    "survey_files",
    "survey_findings",
)
def survey_files_per_kind(f: DataFrame, g: DataFrame) -> DataFrame:
    return survey.files_per_kind(f, g)


@register(
    "survey_hiding",
    """+ b AS (SELECT file_id, detector, count(*) AS n, min((line, emit_seq)) AS spot FROM survey_findings GROUP BY ALL)
SELECT file_id, rel_path, string_agg(detector, ', ' ORDER BY spot) AS detectors, sum(n)::BIGINT AS findings FROM b JOIN survey_files USING (file_id) GROUP BY file_id, rel_path""",
    "survey_files",
    "survey_findings",
)
def survey_hiding(f: DataFrame, g: DataFrame) -> DataFrame:
    return survey.hiding(f, g)


@register("survey_refused", "SELECT file_id, rel_path, refusal FROM survey_files WHERE refusal IS NOT NULL", "survey_files")
def survey_refused(f: DataFrame) -> DataFrame:
    return survey.refused(f)


@register(
    "survey_totals",
    """SELECT (SELECT count(*) FROM survey_files) AS files, (SELECT count(*) FROM survey_files WHERE refusal IS NULL) AS read, (SELECT count(*) FROM survey_files WHERE refusal IS NOT NULL) AS refused,
(SELECT count(DISTINCT file_id) FROM survey_findings) AS hiding, (SELECT count(*) FROM survey_findings) AS findings, 1 AS exit_code""",
    "survey_files",
    "survey_findings",
)
def survey_totals(f: DataFrame, g: DataFrame) -> DataFrame:
    return survey.totals(f, g)


@register(
    "survey_merged",
    """+ d AS (SELECT file_id, rel_path, refusal, unnest(['', split_part(rel_path, '/', 1)]) AS folder FROM survey_files),
b AS (SELECT file_id, detector, count(*) AS n, min((line, emit_seq)) AS spot FROM survey_findings GROUP BY ALL),
e AS (SELECT * FROM d JOIN b USING (file_id))
SELECT folder, detector, NULL::BIGINT AS files, NULL::BIGINT AS read, NULL::BIGINT AS refused, count(*) AS hiding, sum(n)::BIGINT AS findings, arg_min(rel_path, (string_split(rel_path, '/'), spot)) AS first FROM e GROUP BY folder, detector
UNION ALL SELECT folder, NULL, files, read, refused, hiding, findings, first
FROM (SELECT folder, count(*) AS files, count(*) FILTER (WHERE refusal IS NULL) AS read, count(*) FILTER (WHERE refusal IS NOT NULL) AS refused FROM d GROUP BY folder)
JOIN (SELECT folder, count(DISTINCT file_id) AS hiding, sum(n)::BIGINT AS findings, arg_min(rel_path, (string_split(rel_path, '/'), spot)) AS first FROM e GROUP BY folder) USING (folder)""",
    "survey_files",
    "survey_findings",
)
def survey_merged(f: DataFrame, g: DataFrame) -> DataFrame:
    """Files arrive in three batches, the second of them twice, and the first two are settled; the totals are those of all files at once."""
    grown = rollup.Growing(f.sparkSession, shared_path(f.sparkSession, "survey"))
    batch = F.crc32("file_id") % 3
    for number in (0, 1, 1, 2):
        grown.add(number, f.where(batch <= number), g)
        if number == 1:
            grown.settle(1)
    return grown.totals()


@register(
    "findings_union_ordered",
    f"""+ f AS (SELECT doc_id::VARCHAR AS file_id, 'tag-characters' AS detector, least(length(split_part(text, chr(10), 1)), 10) + 1 AS c FROM documents UNION ALL SELECT doc_id::VARCHAR, 'mixed-script', 2 * (doc_id % 7) + 2 FROM documents)
SELECT file_id, detector, row_number() OVER (PARTITION BY file_id ORDER BY c, detector DESC) AS place FROM f""",
    "units_tags",
    "units_mixed",
)
def findings_union_ordered(t: DataFrame, m: DataFrame) -> DataFrame:
    """Every detector's findings of a file in one order: position, then emission."""
    from pyspark.sql import Window

    from ..operators.findings import order

    both = union([characters.tag_characters(t), characters.mixed_script(m)])
    return both.select("file_id", "detector", F.row_number().over(Window.partitionBy("file_id").orderBy(*order()[1:])).cast("long").alias("place"))


# Sources: files made of the tables, and what their readers find


def _people(customers: DataFrame) -> DataFrame:
    return customers.select(F.col("c_custkey").alias("key"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.concat(F.lit("A"), F.col("c_nationkey")).alias("author"))


@register("source_plain", "SELECT doc_id || '.txt' AS file_id, text FROM documents WHERE regexp_matches(text, '[^\\s]')", "documents")
def source_plain(docs: DataFrame) -> DataFrame:
    (units,) = P.records_of(docs.select(F.col("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("text")), lambda r: r["text"].encode(), "txt", "units")
    return units.select("file_id", "text")


@register(
    "source_word",
    """SELECT c_custkey || '.docx' AS file_id, 'units' AS record, c_name || chr(10) || 'of ' || CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END AS text, NULL AS author, NULL AS date FROM customer
UNION ALL SELECT c_custkey || '.docx', CASE WHEN c_custkey % 2 = 0 THEN 'insertion' ELSE 'deletion' END, c_mktsegment, 'A' || c_nationkey, CASE WHEN c_custkey % 2 = 1 THEN '2024-01-02T00:00:00Z' END FROM customer
UNION ALL SELECT c_custkey || '.docx', 'creator', 'A' || c_nationkey, NULL, NULL FROM customer""",
    "customer",
)
def source_word(customers: DataFrame) -> DataFrame:
    units, changes, fields = P.records_of(_people(customers), P.word, "docx", "units", "revisions", "meta_fields")
    none = F.lit(None).cast("string")
    rows = units.select("file_id", F.lit("units").alias("record"), "text", none.alias("author"), none.alias("date"))
    rows = rows.unionByName(changes.select("file_id", F.col("kind").alias("record"), "text", "author", "date"))
    return rows.unionByName(fields.select("file_id", F.lower(F.regexp_replace("name", "^.*:", "")).alias("record"), F.col("value").alias("text"), none.alias("author"), none.alias("date")))


@register(
    "source_open_text",
    """SELECT c_custkey || '.odt' AS file_id, c_name AS shown, c_mktsegment AS deleted, 'A' || c_nationkey AS author, '2024-05-01' AS date FROM customer""",
    "customer",
)
def source_open_text(customers: DataFrame) -> DataFrame:
    units, changes = P.records_of(_people(customers), P.open_text, "odt", "units", "revisions")
    return units.select("file_id", F.col("text").alias("shown")).join(changes.where("kind = 'deletion'").select("file_id", F.col("text").alias("deleted"), "author", "date"), "file_id")


@register(
    "source_carried",
    """SELECT s_nationkey || '.docx' AS file_id, 's' || s_suppkey || '.docx' AS inside, 'units' AS record, s_name || chr(10) || 'of ' || CASE WHEN s_suppkey % 2 = 0 THEN 'carries' ELSE '' END AS text FROM supplier
UNION ALL SELECT s_nationkey || '.docx', 's' || s_suppkey || '.docx', CASE WHEN s_suppkey % 2 = 0 THEN 'insertion' ELSE 'deletion' END, 'carries' FROM supplier
UNION ALL SELECT s_nationkey || '.docx', '', 'attachment', 's' || s_suppkey || '.docx' FROM supplier
UNION ALL SELECT DISTINCT s_nationkey || '.docx', '', 'units', 'container ' || s_nationkey || chr(10) || 'of ' FROM supplier
UNION ALL SELECT DISTINCT s_nationkey || '.docx', '', 'deletion', 'carries' FROM supplier""",
    "supplier",
)
def source_carried(suppliers: DataFrame) -> DataFrame:
    """A container a nation, which carries a package a supplier: the packages are rows, dealt out anew and parsed apart."""
    units, changes, attached = P.records_of(P.grouped(suppliers, "s_nationkey", "s_suppkey", "s_name"), P.container, "docx", "units", "revisions", "attachments")
    rows = units.select("file_id", "inside", F.lit("units").alias("record"), "text")
    return rows.unionByName(changes.select("file_id", "inside", F.col("kind").alias("record"), "text")).unionByName(attached.select("file_id", "inside", F.lit("attachment").alias("record"), F.col("name").alias("text")))


_SUPPLIERS = "SELECT s_nationkey AS key, s_suppkey AS id, s_name AS name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey, s_name) AS n FROM supplier"


@register(
    "source_workbook",
    f"""+ s AS ({_SUPPLIERS})
SELECT key || '.xlsx' AS file_id, 'cell' AS record, n AS row, c AS col, CASE c WHEN 1 THEN name ELSE id::VARCHAR END AS text FROM s, (SELECT unnest([1, 2]) AS c)
UNION ALL SELECT key || '.xlsx', 'row', n, NULL, NULL FROM s WHERE id % 3 = 0
UNION ALL SELECT DISTINCT key || '.xlsx', 'column', 2, NULL::INT, NULL FROM s""",
    "supplier",
)
def source_workbook(suppliers: DataFrame) -> DataFrame:
    cells, axis = P.records_of(P.grouped(suppliers, "s_nationkey", "s_suppkey", "s_name"), P.workbook, "xlsx", "cells", "hidden_axis")
    rows = cells.select("file_id", F.lit("cell").alias("record"), "row", "col", "text")
    return rows.unionByName(axis.select("file_id", F.col("axis").alias("record"), F.col("idx").alias("row"), F.lit(None).cast("long").alias("col"), F.lit(None).cast("string").alias("text")))


@register(
    "source_open_sheet",
    f"""+ s AS ({_SUPPLIERS})
SELECT key || '.ods' AS file_id, 'cell' AS record, n AS row, name AS text FROM s UNION ALL SELECT key || '.ods', CASE WHEN id % 5 = 0 THEN 'row' ELSE 'filter' END, n, NULL FROM s WHERE id % 5 = 0 OR id % 2 = 0""",
    "supplier",
)
def source_open_sheet(suppliers: DataFrame) -> DataFrame:
    cells, axis = P.records_of(P.grouped(suppliers, "s_nationkey", "s_suppkey", "s_name"), P.open_sheet, "ods", "cells", "hidden_axis")
    return cells.select("file_id", F.lit("cell").alias("record"), "row", "text").unionByName(axis.select("file_id", F.col("axis").alias("record"), F.col("idx").alias("row"), F.lit(None).cast("string").alias("text")))


@register("source_deck", "SELECT conv_id || '.pptx' AS file_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS number, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text, turn % 3 = 2 AS hidden FROM conversations", "conversations")
def source_deck(turns: DataFrame) -> DataFrame:
    (slides_,) = P.records_of(P.grouped(turns, "conv_id", "turn", "text"), P.deck, "pptx", "slides")
    return slides_.select("file_id", "number", "text", "hidden")


@register(
    "source_portable",
    """SELECT c_custkey || '.pdf' AS file_id, c_name || chr(10) || c_mktsegment AS drawn, c_mktsegment AS unpainted, 'A' || c_nationkey AS author FROM customer""",
    "customer",
)
def source_portable(customers: DataFrame) -> DataFrame:
    glyphs, units, fields = P.records_of(_people(customers), P.portable, "pdf", "glyphs", "units", "meta_fields")
    text = lambda df, name: df.groupBy("file_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("run_no", "glyph_no", "ch")))["ch"], "").alias(name))
    drawn = units.select("file_id", F.col("text").alias("drawn"))
    return drawn.join(text(glyphs.where("mode = 3"), "unpainted"), "file_id").join(fields.where("name = 'Author'").select("file_id", F.col("value").alias("author")), "file_id")


@register("source_photograph", "SELECT p_partkey || '.jpg' AS file_id, 800 AS w, p_partkey % 97 + 400 AS h, 160 AS tw, 84 AS th, p_name AS creator FROM part", "part")
def source_photograph(parts: DataFrame) -> DataFrame:
    images, fields = P.records_of(parts.select(F.col("p_partkey").alias("key"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), P.photograph, "jpg", "images", "meta_fields")
    return images.select("file_id", "w", "h", "tw", "th").join(fields.where("name = 'dc:creator'").select("file_id", F.col("value").alias("creator")), "file_id")
