"""Text expressions: stripping, line handling, body cleaning and fallback."""

from pyspark.sql import Column, functions as F

# The characters that count as whitespace, the line ends, and a
# run of page numbers such as " - 1 - 2" or "* 1 * 2". Two repeats decide where
# a longer run starts. White space before the run is cut off afterwards, which
# is much cheaper than looking for it at every position.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
_PAGE_NUMBER = f"[-*\u2022][{WHITESPACE}]*\\p{{Nd}}+(?![\\p{{L}}\\p{{N}}_])"
PAGE_NUMBER_RUN = f"{_PAGE_NUMBER}[{WHITESPACE}]*{_PAGE_NUMBER}"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use the result several times in ``body``.

    An expression named inside a lambda is computed again for every element;
    binding it to a lambda variable computes it once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Remove Unicode whitespace at both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def split_lines(text: Column) -> Column:
    """Lines of a text, for every Unicode line end; no empty line after the last end."""
    return let(
        F.split(text, LINE_END, -1),
        lambda parts: F.when(
            F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)
        ).otherwise(parts),
    )


def cut_page_numbers(text: Column) -> Column:
    """Drop the first run of page numbers and everything behind it."""
    return let(
        F.split(text, PAGE_NUMBER_RUN, 2),
        lambda parts: F.when(F.size(parts) == 2, F.rtrim(F.get(parts, 0), F.lit(WHITESPACE))).otherwise(F.get(parts, 0)),
    )


def drop_repeated_lines(lines: Column) -> Column:
    """Keep the first of each line (compared stripped); blank lines all stay.

    Sorting by (key, position) puts repeats side by side, so the cost per
    document is n log n and no data leaves the row.
    """
    keyed = F.sort_array(
        F.transform(
            lines, lambda line, pos: F.struct(strip(line).alias("key"), pos.alias("pos"), line.alias("line"))
        )
    )
    kept = let(
        keyed,
        lambda rows: F.filter(
            rows,
            lambda row, i: (row["key"] == "") | (i == 0) | (row["key"] != F.get(rows, i - 1)["key"]),
        ),
    )
    in_order = F.sort_array(
        F.transform(kept, lambda row: F.struct(row["pos"].alias("pos"), row["line"].alias("line")))
    )
    return F.transform(in_order, lambda row: row["line"])


def clean_body(text: Column) -> Column:
    """Cut page numbers, drop repeated lines, join with newlines, strip."""
    lines = drop_repeated_lines(split_lines(cut_page_numbers(text)))
    return strip(F.array_join(lines, "\n"))


def first_filled(*texts: Column) -> Column:
    """First text that is neither null nor empty, else ''. Blanks count as filled."""
    return F.coalesce(*[F.nullif(text, F.lit("")) for text in texts], F.lit(""))


def article_body(columns, full_body="full_body", summary="rss_summary", description="description") -> Column:
    """Body of an article: the scraped text, else the feed summary, else the description.

    ``columns`` lists what the frame has; missing ones are skipped.
    """
    present = [F.col(name) for name in (full_body, summary, description) if name in columns]
    return first_filled(*present)


def full_text(title: Column, body: Column) -> Column:
    """Title and body as one text; a null title counts as ''."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(". "), body)
