
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from webloom.llm import leakage, main_content, residue
from webloom.sources import extract, feeds

SENTENCE = "The council of the town met on Monday to talk about the bridge and its repair, which is dear and slow. "


def test_run_beside_its_own_words():
    rng = random.Random(4)
    ids = lambda xs: np.array([x * 0x9E3779B97F4A7C15 % 2**64 for x in xs], np.uint64)
    for length, changed in ((15, ()), (16, ()), (17, ()), (15, (5, 10)), (18, (4, 9, 14))):
        for gap in range(1, 7):
            item = list(range(1, 61))
            passage = [900 + i if i in changed else x for i, x in enumerate(item[10 : 10 + length])]
            around = [rng.randrange(1000, 2000) for _ in range(60)]
            doc = around[:30] + [item[10]] + around[30 : 30 + gap - 1] + passage + [item[10 + length - 1]] + around[40:]
            assert leakage.has_run(ids(item), ids(doc), 30 + gap - 10 - 6, 30 + gap - 10 + 6), (length, changed, gap)


def test_passage_after_its_own_first_word():
    item = " ".join(f"item{i}" for i in range(60))
    passage = " ".join(f"item{i}" for i in range(10, 25))
    other = " ".join(f"other{i}" for i in range(40))
    docs = [f"{other} item10 {' '.join(f'filler{i}' for i in range(gap))} {passage} {other}" for gap in range(7)]
    assert sorted(leakage.Items([(1, item)]).found_in([*docs, other, None])) == [(i, 1) for i in range(7)]


def plain_run(item, doc, least=15):
    best = {}  # (start, i, j): changes of the best chain from item word start to the pair i, j
    for i, x in enumerate(item):
        for j, y in enumerate(doc):
            if x == y:
                own = {i: 0}
                for (s, a, b), c in best.items():
                    if a < i and b < j:
                        own[s] = min(own.get(s, 99), c + max(i - a, j - b) - 1)
                for s, c in own.items():
                    if i - s + 1 >= least and 6 * c <= i - s + 1:
                        return True
                    best[s, i, j] = c
    return False


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_run_equals_plain_search(seed):
    rng = random.Random(seed)
    item = [rng.choice([1, 2, *range(3, 50)]) for _ in range(rng.randrange(14, 45))]
    doc = []
    for x in item[rng.randrange(0, 8) :]:
        r = rng.random()
        doc += [] if r < 0.05 else [99] if r < 0.12 else [x, 98] if r < 0.16 else [x]
    doc = [1, 2] + doc
    got = leakage.has_run(np.array(item, np.uint64), np.array(doc, np.uint64), -len(item), len(doc))
    assert got == plain_run(item, doc)


def test_item_words_are_never_forgotten():
    ids = {}
    leakage.word_ids([f"x{i}" for i in range(2_000_001)], ids, grow=True)
    assert len(ids) == 2_000_001
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(5)]
    assert sorted(leakage.Items(rows).found_in([t for _, t in rows])) == [(i, i) for i in range(5)]


UNLISTED = ["Sorry, our machines are having a bad day.\nCome back in a few minutes and it should be fine again.", "This part of the site rests right now.\nOur staff were told and look into it."]


def test_messages_of_unlisted_wording(spark):
    rng = random.Random(3)
    verbs, things = "moved opened closed painted sold measured".split(), "bridge mill harbour school station market".split()
    rows, want = [], set()
    for i in range(900):
        bad = rng.random() < 0.25
        body = rng.choice(UNLISTED) if bad else "\n".join(f"The council of the town has {rng.choice(verbs)} the {rng.choice(things)} and the {rng.choice(things)} in {rng.randrange(1900, 2020)}." for _ in range(rng.randrange(1, 4)))
        host = i % 40
        if bad:
            want.add(i)
        # half of the hosts answer 200 on every page; the wording is known from the others
        rows.append((i, f"A {rng.choice(things)}", body, f"h{host}.example", (503 if bad and host % 2 else 200,)))
    pages = spark.createDataFrame(rows, "page_id long, title string, body_text string, domain string, metadata struct<status_code:int>")
    got = {r.page_id for r in residue.residue_pages(pages).collect()}
    assert not any(residue.cues(x.lower()) for text in UNLISTED for x in text.split("\n"))
    assert got == want


def test_furniture_is_no_message():
    text = residue.without_furniture("Home | News | Sport\n\nWe use cookies to count visits.")
    assert text == "" and residue.weak_label("A bridge", text, 200) == 0 and residue.weak_label("404 Not Found", text, 200) == 1
    assert residue.weak_label("Oh", UNLISTED[0], 503) == 1 and residue.weak_label("A bridge", SENTENCE, 200) == 0
    assert residue.weak_label(None, None, None) == -1 and len(residue.features([None], [""])[0]) == 0
    assert "{{ name }}" in residue.without_furniture("Related: {{ name }}")


OLD_RULE = re.compile(r"(?:(?<=\s)|^)[.#@]?[\w-][\w\s,>.#:()-]{0,200}\{[^{}]*\}", re.M)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", ".b", "{", "}", " ", "\n", '"', "#", ":", "x" * 99, "y " * 60, "{c:1}", "é"]), max_size=14).map("".join))
def test_css_rules_as_below_the_old_bound(text):
    assert extract._without_rules(text) == OLD_RULE.sub("", text)


def test_css_rules_of_long_pages():
    page = 'He wrote "the set of all x" = {1, 2} and went on!\n.menu a { color: red }\nThe end of it.'
    want = 'He wrote "the set of all x" = {1, 2} and went on!\n\nThe end of it.'
    assert extract.without_css(page) == want
    long = "\n".join([page] * 4_000)
    assert len(long) > 200_000 and extract.without_css(long) == "\n".join([want] * 4_000)
    assert extract.without_css("{" * 300_000) and extract.without_css("a " * 200_000 + "{") and extract.without_css("a{" * 200_000)


def test_results_close_together():
    links = "".join(f'<li><a class="result__a" href="https://s{i}.example/p">Title {i}</a> Words {i}.</li>' for i in range(8))
    got = feeds.parse_results("https://html.duckduckgo.com/html/?q=x", f'<a href="/">Home</a> {links}')
    assert [(r["url"], r["title"], r["snippet"]) for r in got] == [(f"https://s{i}.example/p", f"Title {i}", f"Words {i}.") for i in range(8)]


def test_html_after_a_long_lead():
    page = f"<div><p>{SENTENCE}</p><p>{SENTENCE}It ends.</p></div>"
    assert main_content.main_html_lines(" " * 5_000 + page) == main_content.main_html_lines(page) != []
