import random
from collections import Counter

import pytest
from helpers import ROWS, documents, same, with_clashes, words

from thali.llm import quality_rules as Q


def brute(text):
    text = text or ""
    w = words(text)
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), failed


def test_statistics_as_brute_force(spark):
    rows = [*ROWS, (20, "a b c a b c # $ %\nx | y\nx | y\n \nz\n\n", "en", "a", 0), (21, "p p p p", "en", "a", 0)]
    found = Q.verdicts(with_clashes(documents(spark, rows))).collect()
    assert len(found) == len(rows)
    by = {i: t for i, t, *_ in rows}
    for r in found:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(by[r.doc_id])


def pages(n, own=40, host="h", start=0):
    """Documents with a common header and many lines of their own."""
    return [(start + i, "Home  About\n" + "\n".join(f"line{start + i} {j} has{j} words{j} of{j} its{j} own{j}" for j in range(own)),
             "en", host, 0) for i in range(n)]


def test_common_lines_go_and_depleted_documents_are_rejected(spark):
    rng = random.Random(0)
    pool = [f"menu{k} item{k} number{k} of{k} this{k} site{k}" for k in range(100)]
    rows = pages(40)
    rows += [(100 + i, "\n".join(rng.sample(pool, 30)) + f"\nonly {i} is own", "en", "h", 0) for i in range(300)]
    rows += pages(5, host=None, start=900)
    found = {r.doc_id: r for r in Q.verdicts(documents(spark, rows)).collect()}
    assert all(found[i].kept and found[i].removed_words == 2 for i in range(40))
    assert all(found[100 + i].depleted and not found[100 + i].kept and not found[100 + i].base_failed for i in range(300))
    assert all(found[900 + i].kept and found[900 + i].removed_words == 0 for i in range(5))
    docs = with_clashes(documents(spark, rows))
    clean = Q.clean_documents(docs)
    assert clean.columns == docs.columns
    by = {r.doc_id: r for r in clean.collect()}
    assert by[7].text.startswith("line7 0") and by[7].n_chars == len(by[7].text) and "Home" in by[900].text
    assert 105 not in by


def test_copies_are_no_boilerplate(spark):
    text = "\n".join(f"sentence{j} of{j} a{j} text{j} that{j} is{j} copied{j}" for j in range(20))
    rows = [(i, text, "en", "h", 0) for i in range(100)]
    # the same lines in another order, case and spacing are the same set
    rows += [(200 + i, "\n".join(reversed(text.split("\n"))).upper() + "\n \n", "en", "h", 0) for i in range(100)]
    assert all(r.kept for r in Q.verdicts(documents(spark, rows)).collect())


@pytest.mark.parametrize("shift", range(3))
def test_pages_of_one_template_are_depleted(spark, shift):
    template = "\n".join(f"part{j} of{j} the{j} template{j} number{shift}" for j in range(30))
    rows = [(i, template + f"\nonly line {i + 1000 * shift} is own", "en", "h", 0) for i in range(300)]
    rows += pages(50, start=1000)
    found = {r.doc_id: r for r in Q.verdicts(documents(spark, rows)).collect()}
    assert all(found[i].depleted and found[i].removed_words == 150 and not found[i].kept for i in range(300))
    assert all(found[1000 + i].kept for i in range(50))


def test_a_line_in_very_many_documents_goes_in_a_host_of_any_size(spark):
    rows = [(i, (f"common line {i % 2}\n" if i < 60 else "") + " ".join(f"w{i}x{j}" for j in range(60)), "en", "h", 0) for i in range(2000)]
    for cap, gone in ((10_000, 0), (29, 60), (30, 0)):
        found = Q.verdicts(documents(spark, rows), min_docs=20, max_docs=cap).collect()
        assert sum(r.removed_words > 0 for r in found) == gone and all(r.kept for r in found)


def test_very_long_documents(spark):
    rows = pages(30) + [(999, "Home About\n" + "\n".join(f"l{j} m{j}" for j in range(200_000)), "en", "h", 0)]
    r = {x.doc_id: x for x in Q.verdicts(documents(spark, rows)).collect()}[999]
    assert (r.n_words, r.removed_words, r.kept) == (400_002, 2, True)


def test_repeated_rows_and_clashing_ids(spark):
    rows = pages(3) + pages(1) + [(1, "other text " * 60, "en", "h", 0)]
    found = Q.verdicts(documents(spark, rows)).collect()
    assert len(found) == 5 and sum(r.kept for r in found) == 4 and not any(r.kept for r in found if r.n_words == 120)


def test_null_texts_are_kept_out_and_empty_tables_stay_empty(spark):
    assert {r.doc_id for r in Q.clean_documents(documents(spark)).collect()} <= {r[0] for r in ROWS}
    assert Q.verdicts(documents(spark, [])).count() == 0
    assert Q.clean_documents(documents(spark, [])).count() == 0
    assert same(Q.verdicts(documents(spark)).select("doc_id", "kept"),
                Q.verdicts(with_clashes(documents(spark))).select("doc_id", "kept"))
