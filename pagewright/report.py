"""Reports as text. Every figure comes from a one-row DataFrame or a bounded list."""

from __future__ import annotations

LINE = "=" * 50


def head(title: str) -> list[str]:
    return [LINE, title, LINE]


def extraction(stats: dict, context_words: int = 4) -> str:
    out = head("EXTRACTION SUMMARY") + [f"Total pages:            {stats['total_pages']}", f"Successfully extracted: {stats['successful']}", f"Insufficient text:      {stats['insufficient_text']}", f"Failed:                 {stats['failed']}"]
    if context_words > 0:
        out += ["", f"Context extraction ({context_words} words):", f"  Full context:    {stats['context_extracted']}", f"  Partial context: {stats['context_partial']}"]
        out += [f"  Failed:          {stats['context_failed']}"] if stats["context_failed"] else []
    if stats["insufficient_text"] or stats["failed"]:
        out += ["", "Some pages need a snippet by hand: look for the placeholders in the JSON file."]
    return "\n".join(out)


def validation(r: dict) -> str:
    """Of the dictionary that operators.validate.results() gives."""
    out = head("VALIDATION RESULTS") + [f"Total snippets:     {r['total_snippets']}", f"Unique snippets:    {r['unique_snippets']}", f"Needs manual entry: {r['placeholder_count']}"]
    if r.get("context_full") or r.get("context_partial"):
        out += ["", "Context coverage:", f"  Full context:    {r['context_full']}", f"  Partial context: {r['context_partial']}", f"  No context:      {r['context_none']}"]
    dup = r["duplicate_snippets"]
    if dup:
        out += ["", f"Duplicate snippets found: {len(dup)}"] + ["  Context matching will help to tell them apart."] * bool(r.get("context_full"))
        out += [f'  "{s[:60]}..." (appears {n} times)' for s, n in list(dup.items())[:5]]
        out += [f"  ... and {len(dup) - 5} more"] * (len(dup) > 5)
    if "missing_from_html" in r:
        gone = r["missing_from_html"]
        out += ["", f"HTML match rate: {r['html_match_rate']:.1%}"]
        if gone:
            out += [f"Snippets not found in HTML: {len(gone)} pages", f"  Pages: {gone[:10]}"] + [f"  ... and {len(gone) - 10} more"] * (len(gone) > 10)
    out += ["", "Next steps:"]
    out += ["  1. Replace the placeholder entries in the JSON file"] * bool(r["placeholder_count"])
    out += ["  2. Make duplicate snippets more specific"] * bool(dup)
    out += ["  3. Check missing snippets, or use other text"] * bool(r.get("missing_from_html"))
    if not r["placeholder_count"] and not dup and r.get("html_match_rate", 1.0) > 0.95:
        out += ["  Ready to use"]
    return "\n".join(out)


def marking(s: dict, failed: list[dict] = ()) -> str:
    """Of the row of operators.mark.stats(), and rows of operators.mark.failed()."""
    out = head("SUMMARY") + [f"Total references:   {s['found'] + s['not_found']}", f"Successfully found: {s['found']}", f"Not found:          {s['not_found']}", f"Multiple matches:   {s['multiple_matches']}"]
    out += [f"Context disambiguations: {s['context_used']}"] * bool(s["context_used"])
    out += [f"Context fallbacks: {s['context_fallback']} (verify these placements)"] * bool(s["context_fallback"])
    out += [f"Out-of-order removed: {s['out_of_order']}", f"Final markers kept: {s['kept']}"] if s["out_of_order"] else []
    if failed:
        out += ["", *head("FAILED PAGES REPORT"), f"Pages that could not be inserted: {', '.join(str(f['page']) for f in failed)}"]
        for f in failed:
            shown = f["snippet"][:60] + "..." if len(f["snippet"]) > 60 else f["snippet"]
            out += ["", f"Page {f['page']}:", f'  Snippet: "{shown}"', f"  Searched after: container {f['last_container']}, position {f['last_position']}"]
    return "\n".join(out)


def review(low: list[dict], average: float) -> str:
    out = head("WORD SEGMENTATION REVIEW")
    if low:
        out += [f"Found {len(low)} snippets with low confidence (<0.7):"]
        out += [x for r in low[:10] for x in (f"Page {r['page']}: {r['snippet'][:60]}...", f"  Confidence: {r['confidence']}")]
        out += [f"... and {len(low) - 10} more"] * (len(low) > 10)
    else:
        out += ["All snippets have high confidence (>=0.7)"]
    return "\n".join([*out, f"Average confidence: {average:.2f}", LINE])
