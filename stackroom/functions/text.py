"""Scalar text functions as Column -> Column expressions: no Python runs on the executors.

Character classes are written with \\p{...} so that the JVM sees all scripts. Every function gives null for a
null input unless it says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on these lists and numbers.
STOP_WORDS = "what which how why is are was were the a an of to in on for and or does do did it its this that these those with by as at from be used use using role paper".split()
COMPOUND_PREFIXES = "self state multi non well real fine end long high low cross deep zero few one two three co pre post semi sub part".split()
ABBREVIATIONS = ["e.g.", "i.e.", "et al.", "al.", "Fig.", "Figs.", "Eq.", "Eqs.", "Sec.", "Secs.", "Tab.", "vs.", "cf.", "approx.", "Ref.", "Refs.", "No.", "Nos.", "Mr.", "Ms.", "Dr.", "Prof.", "St.", "Inc.", "Ltd.", "i.e", "e.g"]
MIN_CLAIM, CJK_WEIGHT = 25, 3.0
CJK_TOKENS, CHARS_PER_TOKEN = 1.5, 3.5
#: Ranges of scripts without spaces; the narrow one leaves out full-width forms.
CJK = r"\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}"
CJK_NARROW = r"\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}\x{3000}-\x{303F}"
WORD_SPLIT = r"[^\p{L}\p{N}_\-.]+"
EDGES = r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$"
#: A run of what WORD_SPLIT leaves, without its EDGES, that has a letter or digit.
WORD = r"(?:[\p{L}\p{N}]|_[_\-.]*[\p{L}\p{N}])(?:[\p{L}\p{N}_\-.]*[\p{L}\p{N}_])?"
SPACES = r"[\t \x{00A0}\x{2000}-\x{200B}\x{202F}\x{205F}\x{3000}]+"
CITATION = r"\[\s*\d+\s*(?:[-–—,;]\s*\d+\s*)*\]|\(\s*[A-Z][A-Za-z'’\-]+(?:\s+(?:et\s+al\.?|and|&)\s*[A-Za-z'’\-]*)?,?\s*(?:19|20)\d{2}[a-z]?\s*\)"
MARKER = r"\[(E\d+)\]"
NUMBER, IDENTIFIER = r"\d+(?:[.,]\d+)*", r"[A-Za-z][A-Za-z0-9-]*\d[A-Za-z0-9-]*"
HEADING_NUMBER = r"(?i)^(?:appendix\s+)?((?:[A-Z]|\d+)(?:\.(?:[A-Z]|\d+)){0,3})\.?\s+\S"
REFERENCES_HEADING = r"(?i)^\s*(?:\d+\.?\s*)?(references|bibliography|works\s+cited|literature\s+cited)\s*$"
ABSTRACT_HEADING = r"(?i)^\s*(?:\d+\.?\s*)?abstract\b"
ACKNOWLEDGEMENTS = r"(?i)^(?:\d+[.)]\s*)?(?:acknowledge?ments?|funding|author contributions)\s*$"
BIBLIOGRAPHY = r"(?i)^(?:\d+[.)]\s*)?(?:bibliography|references|works cited|参考文献)\s*(?:[:：].*)?$"
APPENDIX = r"(?i)^(?:(?:appendix|supplementar|supplementary)\b|附录)"
FRONT_MATTER = r"(?i)^(?:\d+[.)]\s*)?(?:contents|table of contents|list of (?:figures|tables)|keywords?|index terms|abstract|摘要)\s*(?:[:：].*)?$"
ABSTRACT_ROLE = r"(?i)^(?:\d+[.)]\s*)?(?:abstract|摘要)"
READING_FRONT = r"(?i)^(?:\d+[.)]|[IVXLC]+[.)])?\s*(?:abstract|introduction|related\s+work|background|preliminaries|preliminary)\s*(?:[:：].*)?$"
LINE_MARKER = r"(?m)^([ \t]*)(#{1,6}(?=\s)|>|```|~~~|\||[-*+](?=\s)|\d+[.)](?=\s))"
INLINE_MATH = r"(?<![\\$])\$(?!\$)(?:\\.|[^$\\])+?\$(?!\$)"
BOUNDARIES = [". ", "。", "! ", "? ", "; ", ", ", " "]


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def all_of(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


# predicates


def looks_like_prose(c: Column) -> Column:
    return (F.length(F.trim(c)) >= 2) & c.rlike(r"\p{L}")


def ends_sentence(c: Column) -> Column:
    return c.rlike(r"[.!?。！？:;…]\s*$")


def continues(previous: Column, following: Column) -> Column:
    """The previous text is unfinished and the next one starts in lower case or with an opening bracket."""
    return (F.trim(previous) != "") & ~ends_sentence(F.trim(previous)) & following.rlike(r"^\s*[\p{Ll}(\[]")


def has_cjk(c: Column, narrow: bool = True) -> Column:
    return c.rlike(f"[{CJK_NARROW if narrow else CJK}]")


def classify_section(title: Column, is_references: Column) -> Column:
    t = F.trim(title)
    return F.when(is_references | t.rlike(ACKNOWLEDGEMENTS) | t.rlike(APPENDIX) | t.rlike(BIBLIOGRAPHY), "excluded").when(t.rlike(FRONT_MATTER), F.when(t.rlike(ABSTRACT_ROLE), "abstract").otherwise("excluded")).otherwise("substantive")


def is_front_matter(title: Column) -> Column:
    return F.trim(title).rlike(READING_FRONT) | F.trim(title).rlike(r"^(?:摘要|引言|绪论|背景|相关工作|预备知识)\s*(?:[:：].*)?$")


# tokens


def tokens(c: Column) -> Column:
    # found whole, and made lower in one go: a line's end between words is no letter's neighbour
    words = F.array_join(F.regexp_extract_all(c, F.lit(WORD), F.lit(0)), "\n")
    return F.filter(F.split(F.lower(words), "\n"), lambda w: w != "")


def fts_tokens(c: Column) -> Column:
    """Words for the inverted index: hyphens, dots and underscores separate too. Accents stay."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def content_terms(c: Column) -> Column:
    return F.filter(tokens(c), lambda w: ~w.isin(STOP_WORDS) & ((F.length(w) > 1) | w.rlike(r"^\d$")))


def coverage(query: Column, text: Column) -> Column:
    asked = F.array_distinct(content_terms(query))
    return F.when(F.size(asked) == 0, 0.0).otherwise(F.size(F.array_intersect(asked, tokens(text))) / F.size(asked))


def normalize_terms(c: Column) -> Column:
    words = F.transform(F.split(c, WORD_SPLIT), lambda w: F.regexp_replace(w, EDGES, ""))
    return F.transform(F.filter(words, lambda w: w.rlike(r"[\p{L}\p{N}]")), lambda w: F.concat(F.lit('"'), w, F.lit('"')))


def phrase(c: Column) -> Column:
    return F.when(F.trim(c) == "", "").otherwise(F.concat(F.lit('"'), F.trim(c), F.lit('"')))


# white space, wrapped lines, identity


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACES, " "))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def join_wrapped_lines(lines: Column) -> Column:
    """Lines to one string: a line-final hyphen closes before lower case, and stays after a compound's first part."""
    clean = F.filter(F.transform(lines, collapse), lambda x: x != "")

    def add(out: Column, line: Column) -> Column:
        broken = out.rlike(r"\S-$") & line.rlike(r"^\p{Ll}")
        part = F.lower(F.regexp_extract(out, r"(\S+?)-$", 1))
        return F.when(out == "", line).when(broken & F.array_contains(strings(COMPOUND_PREFIXES), part), F.concat(out, line)).when(broken, F.concat(F.substring(out, F.lit(1), F.length(out) - 1), line)).otherwise(F.concat_ws(" ", out, line))

    return collapse(F.aggregate(clean, F.lit(""), add))


def join_printed_lines(lines: Column) -> Column:
    """Lines of a page to one text: a hyphen before lower case goes, letters of scripts without spaces meet, all else gets a space."""
    wide = "[\\x{3000}-\\x{30ff}\\x{3400}-\\x{9fff}\\x{ff00}-\\x{ffef}]"

    def add(out: Column, line: Column) -> Column:
        hyphen = F.endswith(out, F.lit("-")) & line.rlike(r"^\p{Ll}")
        return F.when(out == "", line).when(hyphen, F.concat(F.substring(out, F.lit(1), F.length(out) - 1), line)).when(out.rlike(wide + "$") & line.rlike("^" + wide), F.concat(out, line)).otherwise(F.concat_ws(" ", out, line))

    return F.trim(F.aggregate(F.filter(lines, lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(""), add))


def canonical_source_text(c: Column) -> Column:
    return join_wrapped_lines(F.split(F.replace(c, F.lit("\u00ad"), F.lit("")), "\n"))


def quantize(c: Column, quantum: float = 2.0) -> Column:
    """Snap to a grid, halves to even."""
    return F.bround(F.bround(c / quantum) * quantum, 4)


def anchor_payload(version: Column, content_hash: Column, page: Column, box: Column, text: Column, layout_class: Column | None = None) -> Column:
    edges = [quantize(box[k]).cast("string") for k in ("x0", "y0", "x1", "y1")]
    geometry = F.when(box.isNull(), "none").otherwise(F.concat_ws("|", *edges))
    return F.concat_ws("|", version, content_hash, page.cast("string"), *([layout_class] if layout_class is not None else []), geometry, canonical_source_text(text))


def digest(c: Column) -> Column:
    return F.sha2(c, 256)


# citations, claims, evidence


def citations_in(c: Column) -> Column:
    return all_of(c, CITATION)


def extract_markers(c: Column) -> Column:
    return all_of(c, MARKER, 1)


def claim_weight(c: Column) -> Column:
    wide = F.length(F.regexp_replace(c, f"[^{CJK}]", ""))
    return wide * CJK_WEIGHT + (F.length(c) - wide)


def anchors(c: Column) -> Column:
    body = F.regexp_replace(c, MARKER, " ")
    return F.concat(all_of(body, NUMBER), all_of(body, IDENTIFIER))


def canonical_token(c: Column) -> Column:
    return F.lower(F.replace(c, F.lit(","), F.lit("")))


def split_sentences(c: Column) -> Column:
    """Sentences; decimals and abbreviations don't end one, and markers go with the sentence before them."""
    x = F.regexp_replace(c, r"(?<=\d)[.](?=\d)", "\u0000")
    for i, a in enumerate(ABBREVIATIONS):
        x = F.regexp_replace(x, "(?i)" + a.replace(".", r"\."), f"\u0001{i}\u0001")
    x = F.regexp_replace(x, r"(?<=[.!?])\s+|(?<=[。！？])", "\u0002")
    parts = F.split(x, "\u0002")

    def back(p: Column) -> Column:
        p = F.replace(p, F.lit("\u0000"), F.lit("."))
        for i, a in enumerate(ABBREVIATIONS):
            p = F.replace(p, F.lit(f"\u0001{i}\u0001"), F.lit(a))
        return F.trim(p)

    parts = F.filter(F.transform(parts, back), lambda p: p != "")
    lead = r"^(?:\s*\[E\d+\])+"

    def add(done: Column, p: Column) -> Column:
        head, rest = F.trim(F.regexp_extract(p, lead, 0)), F.trim(F.regexp_replace(p, lead, ""))
        some = F.size(done) > 0
        last = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat_ws(" ", F.get(done, F.size(done) - 1), head)))
        moved = F.when(rest == "", last).otherwise(F.concat(last, F.array(rest)))
        return F.when(some & (head != ""), moved).otherwise(F.concat(done, F.array(p)))

    return F.aggregate(parts, F.array().cast("array<string>"), add)


def claim_sentences(c: Column) -> Column:
    return F.filter(split_sentences(c), lambda s: (claim_weight(s) >= MIN_CLAIM) & s.rlike(r"\p{L}"))


def unknown_markers(answer: Column, valid: Column) -> Column:
    return F.array_except(F.array_distinct(extract_markers(answer)), valid)


def _cut(window: Column, least: Column, trim) -> Column:
    out = trim(window)
    for b in reversed(BOUNDARIES):
        # the last place of the boundary, from the text reversed
        at = F.when(F.instr(window, b) > 0, F.length(window) - F.locate(b[::-1], F.reverse(window)) - len(b) + 1).otherwise(-1)
        out = F.when(at > least, trim(F.substring(window, F.lit(1), at + len(b)))).otherwise(out)
    return out


def snippet_of(c: Column, limit: int = 400) -> Column:
    s = F.trim(c)
    return F.when(F.length(s) <= limit, s).otherwise(_cut(F.substring(s, 1, limit), F.lit(limit // 2), F.trim))


# budgets


def estimate_tokens(c: Column) -> Column:
    wide = F.length(F.regexp_replace(c, f"[^{CJK}]", ""))
    return F.ceil(wide * CJK_TOKENS + (F.length(c) - wide) / CHARS_PER_TOKEN).cast("long")


def truncate_to_tokens(c: Column, most: Column) -> Column:
    rough = F.greatest(F.lit(1), F.floor(most * 3.0).cast("int"))
    window = F.substring(c, F.lit(1), rough)
    return F.when(most <= 0, "").when(estimate_tokens(c) <= most, c).otherwise(_cut(window, F.floor(F.length(window) / 2), F.rtrim))


# literature


def normalize_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def overlap(title: Column, entry: Column) -> Column:
    """Share of the title's words of three letters or more that the entry has; repeats count."""
    words = F.filter(F.split(normalize_title(title), " "), lambda w: F.length(w) > 2)
    have = F.split(normalize_title(entry), " ")
    return F.when(F.size(words) == 0, 0.0).otherwise(F.size(F.filter(words, lambda w: F.array_contains(have, w))) / F.size(words))


def expand_marker(c: Column) -> Column:
    """`3, 5-7` -> [3, 5, 6, 7]; spans of fifty and more and backward ones are ignored."""

    def one(p: Column) -> Column:
        lo, hi = F.try_to_number(F.regexp_extract(p, r"^(\d+)", 1), F.lit("999999999")).cast("int"), F.try_to_number(F.regexp_extract(p, r"^\d+[–-](\d+)$", 1), F.lit("999999999")).cast("int")
        span = p.rlike(r"^\d+[–-]\d+$")
        return F.when(span & (hi > lo) & (hi - lo < 50), F.sequence(lo, hi)).when(span, F.array().cast("array<int>")).when(p.rlike(r"^\d+(?:[–-].*)?$"), F.array(lo)).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(F.trim(c), r"[,\s]+"), one))))


def find_identifier(c: Column) -> Column:
    doi = F.rtrim(F.regexp_replace(F.regexp_extract(c, r"\b(10\.\d{4,9}/[^\s\"<>]+)", 1), r"\.+$", ""))
    arxiv = F.regexp_extract(c, r"(?i)arXiv:\s*(\d{4}\.\d{4,5})", 1)
    return F.when(doi != "", doi).when(arxiv != "", F.concat(F.lit("10.48550/arXiv."), arxiv))


def norm_url(c: Column) -> Column:
    u = F.trim(c)
    host = F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(u, F.lit("HOST")), F.lit(""))), "^www[.]", "")
    path = F.regexp_replace(F.coalesce(F.try_parse_url(u, F.lit("PATH")), F.lit("")), "/+$", "")
    path = F.regexp_replace(path, r"(/abs/[^/]+?)(v\d+)?$", "$1")
    path = F.regexp_replace(F.replace(path, F.lit("/pdf/"), F.lit("/abs/")), r"\.pdf$", "")
    return F.lower(F.concat(host, path))


def public_http_url(c: Column) -> Column:
    host = F.lower(F.coalesce(F.try_parse_url(c, F.lit("HOST")), F.lit("")))
    private = host.rlike(r"^(localhost|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.|0\.0\.0\.0|\[?::1)")
    return c.rlike("(?i)^https?://") & (host != "") & ~private


# formulas, markers, masks


def protect(c: Column) -> tuple[Column, Column]:
    """Text with each inline formula replaced by a numbered token, and the formulas."""
    found = all_of(c, INLINE_MATH)
    parts = F.split(F.regexp_replace(c, INLINE_MATH, "\u0000"), "\u0000", -1)
    text = F.aggregate(F.sequence(F.lit(1), F.size(parts) - 1), F.get(parts, F.lit(0)), lambda s, i: F.concat(s, F.lit("⟦m"), i.cast("string"), F.lit("⟧"), F.get(parts, i)))
    return F.when(F.size(found) == 0, c).otherwise(text), found


def restore(c: Column, formulas: Column) -> Column:
    """The inverse; null unless the tokens are exactly 1..n."""
    pattern = r"⟦\s*m\s*(\d+)\s*⟧"
    ids = F.transform(all_of(c, pattern, 1), lambda x: x.cast("int"))
    n = F.size(formulas)
    parts = F.split(F.regexp_replace(c, pattern, "\u0000"), "\u0000", -1)
    text = F.aggregate(F.sequence(F.lit(1), F.size(parts) - 1), F.get(parts, F.lit(0)), lambda s, i: F.concat(s, F.get(formulas, F.get(ids, i - 1) - 1), F.get(parts, i)))
    whole = F.array_sort(ids) == F.when(n > 0, F.sequence(F.lit(1), n))
    return F.when(n == 0, F.when(F.size(ids) == 0, c)).when(whole, text)


def redact(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?i)\b(bearer)\s+[A-Za-z0-9._~+/=-]+", "$1 ***")
    return F.regexp_replace(c, r"(?i)\b(api[_-]?key|token|secret|password|authorization)\b\s*[=:]\s*[^\s,;&]+", "$1=***")


def sanitize_stem(c: Column, most: int = 80) -> Column:
    s = F.trim(F.regexp_replace(c, r"(?i)\.pdf$", ""))
    s = F.substring(F.regexp_replace(F.regexp_replace(s, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"\s+", "_"), 1, most)
    return F.when(F.regexp_replace(s, "_", "") == "", "document").otherwise(s)


def escape_block(c: Column) -> Column:
    return F.regexp_replace(c, LINE_MARKER, r"$1\\$2")


def markdown_quote(c: Column) -> Column:
    return F.regexp_replace(c, r"(?m)^", "> ")


def looks_rewritten(c: Column) -> Column:
    return c.rlike(r"\{\{v\d+\}\}|</?b\d+>")


def strip_filler(c: Column) -> Column:
    fenced = F.regexp_extract(F.trim(c), r"(?s)^\s*```[a-zA-Z]*\s*\n(.*?)\n?```\s*$", 1)
    body = F.trim(F.when(fenced != "", fenced).otherwise(c))
    return F.trim(F.regexp_replace(body, r"(?i)^(?:here is the translation|translation|translated text)\s*[:：]\s*", ""))


def json_object(c: Column) -> Column:
    """The text of the JSON object in a fenced or prefixed answer, or null."""
    t = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.when((t != "") & F.try_parse_json(t).isNotNull(), t)


# matching


def normalize_unit(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, r"\{v\d+\}", " "), r"[^\p{L}\p{N}_]+", " ")))


def unit_score(unit: Column, paragraph: Column) -> Column:
    """On normalised texts: containment 1, else the contained paragraph's share, else the unit's words found."""
    words = F.array_distinct(F.split(unit, " "))
    return F.when(F.contains(paragraph, unit), 1.0).when(F.contains(unit, paragraph), F.length(paragraph) / F.length(unit)).otherwise(F.size(F.array_intersect(words, F.split(paragraph, " "))) / F.size(words))


def occurs(term: Column, text: Column) -> Column:
    return (term != "") & F.contains(squeeze(F.lower(text)), squeeze(F.lower(term)))


def term_pattern(term: Column) -> Column:
    """A regular expression for a term: any case, whole words, plural allowed."""
    body = F.regexp_replace(F.regexp_replace(F.trim(term), r"([\\.\[\]{}()*+?^$|])", r"\\$1"), r"\s+", r"\\s+")
    left = F.when(term.rlike(r"^\s*[\p{L}\p{N}]"), "(?<![A-Za-z0-9])").otherwise("")
    plural = F.when(term.rlike(r"\p{L}\s*$"), "(?:e?s)?").otherwise("")
    right = F.when(term.rlike(r"[\p{L}\p{N}]\s*$"), "(?![A-Za-z0-9])").otherwise("")
    return F.concat(F.lit("(?i)"), left, body, plural, right)


def term_occurs(term: Column, text: Column) -> Column:
    return (F.trim(term) != "") & F.rlike(text, term_pattern(term))


def expansion_supported(acronym: Column, expansion: Column, text: Column) -> Column:
    fold = lambda c: F.lower(F.regexp_replace(c, r"[\s\-_]+", ""))
    shape, key, t = fold(expansion), F.lower(acronym), fold(text)
    return F.contains(t, F.concat(shape, F.lit("("), key, F.lit(")"))) | F.contains(t, F.concat(key, F.lit("("), shape, F.lit(")")))


def let(value: Column, body) -> Column:
    """`body(value)` with the value made once, however often the body names it: an array of one element holds it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_supports(selected: Column, paragraph: Column) -> Column:
    # from characters, for a substring walks through all that stand before it
    joined = lambda x: F.when(F.size(x) < 3, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(x) - 3, F.lit(0))), lambda i: F.concat(F.get(x, i), F.get(x, i + 1), F.get(x, i + 2)))))
    grams = lambda c: let(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)), joined)
    by_grams = lambda v: let(F.struct(grams(v.a).alias("x"), grams(v.b).alias("y")), lambda g: F.coalesce(F.try_divide(F.size(F.array_intersect(g.x, g.y)), F.size(g.x)) >= 0.25, F.lit(False)))

    def by_words(v: Column) -> Column:
        words = F.struct(F.filter(F.split(v.a, r"[^\p{L}\p{N}]+"), lambda w: w != "").alias("x"), F.split(v.b, r"[^\p{L}\p{N}]+").alias("y"))
        found = lambda w: F.size(F.filter(w.x, lambda x: F.array_contains(w.y, x))) / F.size(w.x)
        return let(words, lambda w: F.when(F.size(w.x) <= 5, False).when(found(w) >= 0.35, True).otherwise(by_grams(v)))

    both = F.struct(squeeze(F.lower(selected)).alias("a"), squeeze(F.lower(paragraph)).alias("b"))
    return let(both, lambda v: F.when(v.a == "", False).when(F.contains(v.b, v.a), True).otherwise(by_words(v)))


def safe_member(c: Column) -> Column:
    return (c != "") & ~c.rlike(r"\\|/$|^/|(^|/)\.\.(/|$)")


def table_to_text(html: Column) -> Column:
    """Rows of an HTML table as lines, cells separated by tabs."""
    rows = all_of(html, r"(?is)<tr\b[^>]*>(.*?)</tr>", 1)
    cells = lambda r: F.transform(all_of(r, r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>", 1), lambda c: squeeze(F.regexp_replace(c, "<[^>]*>", "")))
    return F.array_join(F.transform(rows, lambda r: F.array_join(cells(r), "\t")), "\n")


def scale_box(box: Column, width: Column, height: Column) -> Column:
    """Unit-square box to points, two places; anything malformed is the whole page."""
    ok = F.size(box) == 4
    return F.when(ok, F.array(*[F.round(F.get(box, F.lit(i)) * (width if i % 2 == 0 else height), 2) for i in range(4)])).otherwise(F.array(F.lit(0.0), F.lit(0.0), width, height))


def scale_box_by(box: Column, x: Column, y: Column, width: Column, height: Column) -> Column:
    """A box times these ratios, two places; anything malformed is the whole page."""
    ok = F.size(box) == 4
    return F.when(ok, F.array(*[F.round(F.get(box, F.lit(i)) * (x if i % 2 == 0 else y), 2) for i in range(4)])).otherwise(F.array(F.lit(0.0), F.lit(0.0), width, height))


def confidence(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_to_number(c, F.lit("S999.999")).cast("double"), F.lit(0.5))))
