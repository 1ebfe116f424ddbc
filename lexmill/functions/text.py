"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the document formats.
SENTENCE = r"[^.!?]*[.!?]"
HEADER = r"(#{1,6})\s+(.+)"
SIGNPOST = r"\[([^\]]+)\]\s*\+\s*\[([^\]]+)\]\s*\+\s*\[([^\]]+)\]"
URL_COMMENT = r"<!-- URL: (.+?) -->"
SOURCE_COMMENT = r"<!-- Source: (.+?) -->"


def strip(c: Column) -> Column:
    """Without white space, of any script, at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(c: Column) -> Column:
    """Runs of anything but white space."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def tokens(c: Column) -> Column:
    """Lower-case search tokens: runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def first_sentence(c: Column, most_words: int = 30) -> Column:
    """First sentence behind a leading header line; without a sentence end, the first words.

    Only what is found is stripped and collapsed, not the whole text.
    """
    body = F.regexp_replace(c, r"(?dU)\A#+\s+.+\n", "")
    found = F.regexp_extract(body, rf"(?s)\A({SENTENCE})", 1)  # anchored: a text without a sentence end is read once
    some = F.slice(words(body), 1, most_words)
    rest = F.concat(F.array_join(some, " "), F.when(F.size(some) == most_words, "...").otherwise(""))
    return F.when(found != "", strip(collapse(found))).otherwise(rest)


def last_sentence(c: Column, most_words: int = 30) -> Column:
    """Last sentence; without a sentence end, the last words.  Found from the end, in the text reversed."""
    found = F.regexp_extract(F.reverse(c), r"(?s)\A[^.!?]*([.!?][^.!?]*)", 1)
    every = words(c)
    n = F.size(every)
    some = F.slice(every, F.greatest(n - most_words + 1, F.lit(1)), F.lit(most_words))
    rest = F.concat(F.when(n > most_words, "...").otherwise(""), F.array_join(some, " "))
    return F.when(found != "", strip(collapse(F.reverse(found)))).otherwise(rest)


def chunk_id(header: Column, content: Column) -> Column:
    """Twelve hexadecimal digits that name a header with the beginning of its content."""
    return F.substring(F.sha2(F.concat(header, F.lit(":"), F.substring(content, 1, 100)), 256), 1, 12)


def content_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def word_count(c: Column) -> Column:
    return F.size(words(c))


#: All white space, of any script: what (?U)\s matches.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trimmed(c: Column) -> Column:
    """As strip(), which reads all of a text by a pattern; this looks at its ends only."""
    return F.btrim(c, F.lit(WHITE))


def strip_fence(c: Column) -> Column:
    """Without a code fence around the whole answer (or at its end)."""
    c, mark, fence = trimmed(c), F.lit("```markdown"), F.lit("```")
    c = F.when(F.startswith(c, mark), F.ltrim(F.substr(c, F.lit(12)), F.lit(WHITE))).otherwise(c)
    return F.when(F.endswith(c, fence), F.rtrim(F.substr(c, F.lit(1), F.length(c) - 3), F.lit(WHITE))).otherwise(c)


def clean_markdown(c: Column) -> Column:
    """No blanks at the ends of lines, and one blank line for several."""
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    c = F.regexp_replace(F.regexp_replace(c, r"\n[ \t]++", "\n"), r"[ \t]++\n", "\n")
    # Of lines that are blank the first stays, whatever white space it has; those at either end go below.
    return trimmed(F.regexp_replace(c, r"(?U)(\n[\s&&[^\n]]*+(?=\n))(?:\n[\s&&[^\n]]*+(?=\n))++", "$1"))


def collapse_html(c: Column) -> Column:
    """Without blank lines and with single spaces."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\n\s*\n", "\n"), "  +", " ")


def source_url(markdown: Column, given: Column | None = None) -> Column:
    """The source named in a Markdown comment; one that is given comes first."""
    found = F.nullif(F.regexp_extract(markdown, SOURCE_COMMENT, 1), F.lit(""))
    return found if given is None else F.coalesce(F.nullif(given, F.lit("")), found)


def page_url(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, URL_COMMENT, 1), F.lit(""))


def page_header(url: Column, crawled_at: Column, depth: Column) -> Column:
    """Comment lines put before a stored page."""
    return F.format_string("<!-- URL: %s -->\n<!-- Crawled: %s -->\n<!-- Depth: %s -->\n", url, crawled_at.cast("string"), depth.cast("string"))


def with_source(markdown: Column, url: Column) -> Column:
    """Markdown with its source in a comment before it."""
    return F.concat(F.when(url.isNotNull() & (url != ""), F.format_string("<!-- Source: %s -->\n\n", url)).otherwise(""), markdown)


def parse_signpost(c: Column) -> Column:
    """``core_theme``, ``key_entities``, ``questions_answered`` and whether the text is a signpost."""
    part = lambda k: F.regexp_extract(c, SIGNPOST, k)
    listed = lambda k: F.transform(F.split(part(k), ","), strip)
    none = F.array().cast("array<string>")
    is_one = part(1) != ""
    return F.struct(
        F.when(is_one, strip(part(1))).otherwise(strip(c)).alias("core_theme"),
        F.when(is_one, listed(2)).otherwise(none).alias("key_entities"),
        F.when(is_one, listed(3)).otherwise(none).alias("questions_answered"),
        is_one.alias("is_signpost"),
    )


def format_signpost(theme: Column, entities: Column, header: Column) -> Column:
    return F.format_string("[%s] + [%s] + [What is %s?]", theme, F.when(F.size(entities) > 0, F.array_join(entities, ", ")).otherwise(header), header)


def signpost_tokens(c: Column) -> Column:
    """Estimate: words and a quarter of the characters."""
    return word_count(c) + F.floor(F.length(c) / 4).cast("int")


def strip_thinking(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)<think>.*?</think>", "")


def visible(c: Column) -> Column:
    """What a reader of a stream sees: nothing inside thinking, and nothing behind one that does not end."""
    return F.regexp_replace(strip_thinking(c), r"(?s)<think>.*\z", "")


def thinking(c: Column) -> Column:
    return strip(F.regexp_extract(c, r"(?s)<think>(.*?)</think>", 1))


def is_answer(c: Column) -> Column:
    return (c != "") & ~F.contains(F.lower(c), F.lit("could not find"))
