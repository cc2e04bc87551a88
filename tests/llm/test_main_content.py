"""Main content: surge and dive of the windowed text, and line weights learned from the structure of HTML pages."""

import random

import numpy as np
import pytest

from webloom.llm import main_content as M
from webloom.llm import page_lines as L

SENTENCE = "The council of the town met on Monday to talk about the bridge and its repair, which is dear and slow. "
VERBS, THINGS = "moved opened closed painted sold measured counted praised".split(), "bridge mill harbour school station market garden tower".split()


def prose(rng, n):
    return " ".join(f"The council of the town has {rng.choice(VERBS)} the {rng.choice(THINGS)} and the {rng.choice(THINGS)} in {rng.randrange(1900, 2020)}." for _ in range(n))


# made-up furniture: some sentences, some not; the last of each is in no page that teaches
PROMPTS = ["Tell a neighbour what you have read here.", "Our letter comes to you at seven each day.", "Ring the bell to hear of each new piece.", "Ring the bell and our letter comes at seven."]
LEGAL = ["All words here belong to the house of Numa.", "The house of Numa answers for no losses.", "All losses belong to you and not to the house of Numa."]
MENU = ["Home", "Local", "Sky"]


def html_page(rng, k):
    body = "".join(f"<p>{prose(rng, rng.randrange(1, 4))}</p>" for _ in range(rng.randrange(3, 7)))
    head = f"<h2>The {rng.choice(THINGS)} and what it costs</h2>"
    aside = "".join(f"<p>{x}</p>" for x in rng.sample(PROMPTS[:-1], 2)) + (f"<p>{prose(rng, 1)}</p>" if k % 3 == 0 else "")
    return f"<html><body><div>{''.join(f'<div>{m}</div>' for m in MENU)}<div>{aside}</div></div><section><h1>On the {rng.choice(THINGS)}</h1>{body}{head}{prose(rng, 2)}</section><div><p>{rng.choice(LEGAL[:-1])}</p></div></body></html>"


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    pages = spark.createDataFrame([(i, html_page(rng, i)) for i in range(300)] + [(300, None), (301, ""), (302, "<p>"), (303, "plain")], "fetch_id long, body string")
    return M.fit_weights(pages, "fetch_id", "body")


def test_surge_and_dive():
    assert M.blocks([0, 0, 5, 0, 6, 0, 0, 0, 0, 0, 7]) == [(2, 5), (10, 11)] and M.blocks([]) == [] == M.blocks([0, 0])
    assert M.blocks([0, 1, 0, 0, 0, 90, 0, 1]) == [(5, 8)] and M.blocks([1, 0, 0, 0, 0, 0, 90, 0, 0, 0, 0, 0, 1], share=0.01) == [(0, 1), (6, 7), (12, 13)]
    # the window decides: what is one block through a wide window is two through a narrow one
    weights = [9, 9, 0, 0, 0, 0, 9, 9]
    assert M.blocks(weights, window=3) == [(0, 8)] and M.blocks(weights, window=2) == [(0, 2), (6, 8)]
    assert M.dense([0.0, 0.0]) == [False, False]


def test_window_and_share_change_what_is_kept():
    main = [SENTENCE * 8 + "It ends here." for _ in range(4)]
    body = "\n".join([*main, *["Home"] * 6, "The mill is old and grey.", SENTENCE])
    assert M.main_lines(body) == [0, 1, 2, 3]
    assert M.main_lines(body, share=0.03) == [0, 1, 2, 3, 10, 11] and M.main_lines(body, share=0.0005) == [0, 1, 2, 3, 10, 11]
    assert M.main_lines("\n".join([*main, "Home", "The mill is old and grey."]), window=1) == [0, 1, 2, 3] != M.main_lines("\n".join([*main, "Home", "The mill is old and grey."]), window=3)


def test_words_are_learned_from_structure(model):
    judge = M._Judge(model)
    rng = random.Random(5)
    assert all(model.chance(x) < 0.5 for x in PROMPTS + LEGAL)
    assert np.mean([model.chance(prose(rng, rng.randrange(1, 4))) >= 0.5 for _ in range(200)]) > 0.97
    lines = ["Home", "Local", PROMPTS[0], prose(rng, 2), PROMPTS[3], prose(rng, 3), "The harbour and what it costs", prose(rng, 3), LEGAL[2], "", PROMPTS[1]]
    assert M.main_lines("\n".join(lines), judge) == [3, 5, 6, 7]
    assert M.main_lines("\n".join([PROMPTS[0], LEGAL[0]]), judge) == []


def test_main_html_lines(model):
    judge, rng = M._Judge(model), random.Random(7)
    text = [prose(rng, 3) for _ in range(3)]
    page = f"<html><body><nav><a href=/>Home</a></nav><main><h1>A new bridge</h1><p>{text[0]}</p><p>{PROMPTS[3]}</p><h2>What the work costs</h2><p>{text[1]}</p><ul><li>{text[2]}</li></ul></main><aside><p>{prose(rng, 1)}</p></aside></body></html>"
    assert M.main_html_lines(page, judge) == ["A new bridge", text[0], "What the work costs", text[1], text[2]]
    for none in (None, "", "plain text", "<", "<p></p>", "<div>Home</div>", f"<p>{PROMPTS[0]}</p>"):
        assert M.main_html_lines(none, judge) == []
    assert M.main_html_lines(" " * 5_000 + page, judge) == M.main_html_lines(page, judge)


def test_filler_empty_and_giant_bodies():
    assert M.main_lines("magnor porrex vestra tempra dolor varis. " * 30) == [] == M.main_lines(None) == M.main_lines("") == M.main_lines("\n \n")
    assert M.main_lines("The town is old and the mill is new. " * 20_000) == [0]
    assert M.main_lines(("magnor porrex vestra tempra dolor varis solent. " * 10 + SENTENCE * 30).strip()) == [0]
    assert not L.is_filler("The mill of the town is old.") and L.is_list_of_words("Home | News | Sport") and not L.is_list_of_words("Home, sweet home, is dear to us.")


def test_frames(spark, model):
    rows = [(1, SENTENCE + "\n" + SENTENCE + "\n" + prose(random.Random(3), 2), 7), (2, None, 7), (3, "", 7), (1, SENTENCE, 7)]
    df = spark.createDataFrame(rows, "page_id long, body_text string, row_id int")
    assert M.main_line_keys(df, "page_id", "body_text", False).count() == 3
    assert sorted(r.main_text == "" for r in M.main_text(df, "page_id", "body_text", False).collect()) == [False, False, True, True]
    assert M.main_line_keys(df.limit(0), "page_id", "body_text", False, model).count() == 0 and M.fit_weights(df.limit(0), "page_id", "body_text") is None
    assert M.line_key("a   b\n") == M.line_key("a b")
