from stopfield.llm import line_dedup
from tests.llm.conftest import ODD_TEXTS


def brute(rows):
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        lines = text.split("\n")
        gone = set()
        for i in range(len(lines) - 2):
            window = tuple(lines[i : i + 3])
            if not any(x.strip(" ") for x in window):
                continue
            if window in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(window)
        out[doc_id] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone), sum(1 for i in gone if i - 1 not in gone))
    return out


ROWS = [
    (1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "b\nc\nd"), (4, "a\nb"), (5, "q\nq\nq\nq\nq"), (6, "\n\n\n\nz"), (7, "\n\n\n"),
    (8, "a\nb\nc\nd\nnew\na\nb\nc"), (9, "x\na\nb\nc\ny"), (10, ""),
]


def test_against_brute_force(docs_of):
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed, r.n_spans) for r in line_dedup.deduplicated_lines(docs_of(ROWS)).collect()}
    assert got == brute(ROWS)


def test_rewritten_keeps_columns_and_rows(odd_docs, no_docs):
    out = line_dedup.rewritten(odd_docs)
    assert out.columns == [*odd_docs.columns, line_dedup.REMOVED]
    rows = out.collect()
    assert len(rows) == len(ODD_TEXTS) + 3 and any(r.text is None for r in rows)
    assert all(r[line_dedup.REMOVED] == 0 for r in rows)
    assert line_dedup.deduplicated_lines(no_docs).collect() == [] and line_dedup.rewritten(no_docs).collect() == []


def test_null_text_has_one_empty_line(odd_docs):
    row = line_dedup.deduplicated_lines(odd_docs).filter("doc_id = 0").first()
    assert (row.text, row.n_lines, row.n_removed) == ("", 1, 0)
