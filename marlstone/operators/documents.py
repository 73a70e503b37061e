"""Assembly of articles as array transforms: outlines of given parts, grounding, markdown and HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.text import bound, html_escaped, meta_description, one_line, strip, title_case, without_markdown

# The texts that mark sources, missing data and the closing section.
MISSING = "No internal data was found for this section."
REFERENCES = "## References"
CONCLUSION = "## Conclusion and Strategic Next Steps"
CLOSINGS = "Conclusion|Summary|Final Thoughts|Next Steps|Strategic Next Steps|Conclusion and Next Steps|Concluding Remarks|Key Takeaways"


# How a question begins, and what tells topics of screening from others.
QUESTION = "(?i)^(?:(?:how|what|why|when) (?:is|are|does|do)|how (?:can|to)|does|do|can|is|are) "
SCREENING = "police check|background check|criminal record|identity verification|spent conviction|acic|npc|compliance|vetting|screening|criminal history|disclosure|working with children|wwcc"
#: Our own headings, ``%`` standing for the topic: of topics of screening, of others, and one more for long articles.
FRAME_SCREENING = ["What % Covers", "How % Is Decided", "Records and Data Behind It", "Rules That Apply", "What It Means in Practice"]
FRAME_GENERAL = ["What % Is", "How It Works", "Where It Is in Use", "Risks and Safeguards", "What Comes Next"]
EXTRA = "Common Questions"


def outline(topic: Column, length: Column) -> Column:
    """The headings of an article on a topic: of one of two frames, with one more where it is to be long, and the closing one."""
    short = bound(title_case(topic), lambda t: F.array_join(F.slice(F.split(t, " "), 1, 8), " "))
    named = bound(short, lambda s: F.when(s.rlike(QUESTION), title_case(F.regexp_replace(s, QUESTION, ""))).otherwise(s))
    lists = [F.array(*map(F.lit, x)) for x in (FRAME_SCREENING, FRAME_GENERAL)]
    frame = F.when(F.lower(topic).rlike(SCREENING), lists[0]).otherwise(lists[1])
    more = F.when(length == "long", F.array(F.lit(EXTRA))).otherwise(F.array().cast("array<string>"))
    return bound(named, lambda n: F.concat(F.transform(frame, lambda x: F.replace(x, F.lit("%"), n)), more, F.array(F.lit(CONCLUSION[3:]))))


def drafted_sections(headings: Column, facts: Column, topic: Column) -> Column:
    """A section for each filled heading (what follows a colon in it), holding the fact of the same place or saying that data is missing."""
    def one(h: Column, i: Column) -> Column:
        own = strip(F.regexp_replace(h, "^[^:]*:", ""))
        fact = F.coalesce(F.get(facts, i), F.lit(MISSING))
        return F.struct(own.alias("heading"), F.concat(F.lit("On "), one_line(topic), F.lit(": "), fact).alias("body"))

    return F.filter(F.transform(headings, one), lambda s: s["heading"] != "")


def with_hero(draft: Column, alt: Column, url: Column) -> Column:
    """The draft with one picture after its title, unless it has a picture or no title."""
    head = F.regexp_extract(draft, r"(?:^|\n)[ \t]*# [^\n]+", 0)
    end = F.instr(draft, head) + F.length(head) - 1
    placed = F.concat(F.substring(draft, F.lit(1), end), F.lit("\n\n!["), alt, F.lit("]("), url, F.lit(")\n"), F.substring(draft, end + 1, F.length(draft)))
    return F.when((head == "") | draft.rlike(r"!\[[^\]]*\]\(https?://"), draft).otherwise(placed)


def markdown(title: Column, sections: Column) -> Column:
    """A markdown article of sections array<struct<heading, body>>."""
    body = F.transform(sections, lambda s: F.concat(F.lit("## "), s["heading"], F.lit("\n\n"), strip(s["body"])))
    return F.array_join(F.concat(F.array(F.concat(F.lit("# "), title)), body), "\n\n")


def without_source_lines(body: Column) -> Column:
    return strip(F.array_join(F.filter(F.split(body, "\n"), lambda x: ~F.lower(F.trim(x)).rlike(r"^(source:|\[source:)")), "\n"))


def grounded(sections: Column, references: Column) -> Column:
    """Each section with its citations renewed, or with a sentence that says that data is missing."""
    cites = F.array_join(F.transform(references, lambda r: F.concat(F.lit("[Source: "), r, F.lit("]"))), " ")

    def one(s: Column) -> Column:
        own = without_source_lines(F.coalesce(s["body"], F.lit("")))
        base = F.when(own == "", MISSING).otherwise(own)
        none = F.when(F.contains(base, F.lit(MISSING)), base).otherwise(F.concat(base, F.lit("\n\n" + MISSING)))
        return F.struct(s["heading"].alias("heading"), F.when(F.size(references) > 0, F.concat(base, F.lit("\n\n"), cites)).otherwise(none).alias("body"))

    return F.transform(sections, one)


def with_references(draft: Column, references: Column) -> Column:
    """The draft with one block of references, unless it has one."""
    block = F.concat(F.lit(f"\n\n{REFERENCES}\n"), F.array_join(F.transform(references, lambda r: F.concat(F.lit("- [Source: "), r, F.lit("]"))), "\n"))
    return F.when((F.size(references) == 0) | F.contains(draft, F.lit(REFERENCES)) | F.contains(draft, F.lit("## Sources")), draft).otherwise(F.concat(draft, block))


def with_conclusion(draft: Column, topic: Column) -> Column:
    """The draft with the closing heading: as it is, in place of the first variant of it, or with a stub at the end."""
    pattern = rf"(?mi)^##[ \t]*(?:{CLOSINGS})[^\n]*$"
    found = F.regexp_extract(draft, pattern, 0)
    at = F.instr(draft, found)
    swapped = F.concat(F.substring(draft, F.lit(1), at - 1), F.lit(CONCLUSION), F.substring(draft, at + F.length(found), F.length(draft)))
    stub = F.concat(F.regexp_replace(draft, r"\s+$", ""), F.lit(f"\n\n{CONCLUSION}\n\nThe points above sum up what is known about "), one_line(topic), F.lit("."))
    return F.when(F.contains(draft, F.lit(CONCLUSION)), draft).when(found != "", swapped).otherwise(stub)


def published_markdown(title: Column, draft: Column, sections: Column, sources: Column) -> Column:
    """Front matter, title, sections (the draft if there are none) and sources."""
    t = F.when(strip(F.coalesce(title, F.lit(""))) == "", "Untitled").otherwise(strip(title))
    head = F.concat(F.lit("---\ntitle: "), t, F.lit("\nmeta_description: "), meta_description(title, draft), F.lit("\n---\n\n# "), t, F.lit("\n\n"))
    parts = F.array_join(F.transform(sections, lambda s: F.concat(F.lit("## "), strip(s["heading"]), F.lit("\n\n"), strip(s["body"]))), "\n\n")
    body = F.when(F.size(sections) > 0, parts).otherwise(strip(F.coalesce(draft, F.lit(""))))
    ends = F.when(F.size(sources) > 0, F.concat(F.lit("\n\n## Sources\n\n"), F.array_join(F.transform(sources, lambda s: F.concat(F.lit("- "), s)), "\n"))).otherwise("")
    return F.concat(strip(F.concat(head, body, ends)), F.lit("\n"))


def published_html(title: Column, draft: Column, sections: Column, sources: Column) -> Column:
    """One page with escaped text, a paragraph for each non-blank line of a section."""
    t = html_escaped(F.when(strip(F.coalesce(title, F.lit(""))) == "", "Untitled").otherwise(strip(title)))

    def one(s: Column) -> Column:
        lines = F.filter(F.split(F.coalesce(s["body"], F.lit("")), "\n"), lambda x: F.trim(x) != "")
        return F.concat(F.lit("<section><h2>"), html_escaped(s["heading"]), F.lit("</h2>"), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("<p>"), html_escaped(F.trim(x)), F.lit("</p>"))), ""), F.lit("</section>"))

    whole = F.concat(F.lit("<section><p>"), html_escaped(without_markdown(F.coalesce(draft, F.lit("")))), F.lit("</p></section>"))
    body = F.when(F.size(sections) > 0, F.array_join(F.transform(sections, one), "")).otherwise(whole)
    listed = F.array_join(F.transform(sources, lambda s: F.concat(F.lit("<li>"), html_escaped(s), F.lit("</li>"))), "")
    ends = F.when(F.size(sources) > 0, F.concat(F.lit("<section><h2>Sources</h2><ul>"), listed, F.lit("</ul></section>"))).otherwise("")
    return F.concat(
        F.lit('<!doctype html><html lang="en"><head><meta charset="utf-8" /><title>'), t, F.lit('</title><meta name="description" content="'), html_escaped(meta_description(title, draft)),
        F.lit('" /></head><body><article><h1>'), t, F.lit("</h1>"), body, ends, F.lit("</article></body></html>"))


def trimmed_images(draft: Column, most: Column) -> Column:
    """Drops image lines beyond the first ``most``; null keeps all."""
    lines = F.split(draft, "\n")
    is_image = lambda x: x.rlike(r"!\[[^\]]*\]\([^)]*\)")
    kept = F.filter(lines, lambda x, i: ~is_image(x) | (F.size(F.filter(F.slice(lines, F.lit(1), i + 1), is_image)) <= most))
    return F.when(most.isNull(), draft).otherwise(F.array_join(kept, "\n"))


#: Fixed value: the section that carries an earlier draft, which never keeps a picture.
CONTEXT = "context from previous draft"


def limited_pictures(sections: Column, most: Column) -> Column:
    """Sections array<struct<heading, body, image_url>> of which the first ``most`` keep their picture, not counting the section of context, which keeps none; null keeps all."""
    is_context = lambda s: F.lower(one_line(F.coalesce(s["heading"], F.lit("")))) == CONTEXT

    def one(s: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(sections, F.lit(1), i), lambda x: ~is_context(x)))
        return F.struct(s["heading"].alias("heading"), s["body"].alias("body"), F.when(is_context(s) | (before >= most), "").otherwise(s["image_url"]).alias("image_url"))

    return F.when(most.isNull(), sections).otherwise(F.transform(sections, one))


def allowed_images(draft: Column, most: Column, allowed: Column) -> Column:
    """The draft with only those lines of pictures that show one of the ``allowed`` addresses, the first ``most`` of them; null keeps all."""
    address = lambda x: F.trim(F.regexp_extract(x, r"^\s*!\[[^\]]*\]\(([^)]+)\)\s*$", 1))
    lines = F.split(draft, "\n")
    shows = lambda x: (address(x) != "") & F.array_contains(allowed, address(x))
    kept = F.filter(lines, lambda x, i: (address(x) == "") | shows(x) & (F.size(F.filter(F.slice(lines, F.lit(1), i), shows)) < most))
    return F.when(most.isNull(), draft).otherwise(strip(F.array_join(kept, "\n")))
