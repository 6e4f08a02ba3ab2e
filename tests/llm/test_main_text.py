"""Form of the extracted texts, and broken markup."""

import time

import pytest

from vellum.llm import main_text


def test_blocks_are_parted_by_two_newlines(spark):
    page = "<article><h1>Head</h1><p>One<br>two</p><nav><a href=x>menu</a></nav><p>three</p></article>"
    df = spark.createDataFrame([(1, "u", page), (2, "u", "<p>x</p>")], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in main_text.extract(df).collect()}
    assert got == {1: ("Head\n\nOne\n\ntwo\n\nthree", 21), 2: ("x", 1)}


def test_short_last_section_after_an_advert_stays():
    advert = "<div class=ad><p>Buy</p><p>now</p><p>cheap</p><p>here</p></div>"
    links = "<ul>" + "".join(f"<li><a href=x>link {i}</a></li>" for i in range(4)) + "</ul>"
    for between in (advert, links):
        page = f"<body><p>{'long first part ' * 60}</p>{between}<p>In short.</p></body>"
        assert main_text.main_blocks(page) == [("long first part " * 60).strip(), "In short."]


@pytest.mark.parametrize(("page", "want"), [
    ('<p title="x>Two</p>', "Two"), ("<p title='x>Two</p><p>three</p>", "Two\n\nthree"),
    ('<p title="x>One</p><p title="y>Two</p>', "One\n\nTwo"), ('<p title="a > b">c</p>', "c"), ('<p title = "a>b" class=x>c</p>', "c"),
    ("<p data-x='<b>no</b>'>yes</p>", "yes"), ('<a href="x"class="y>z">t</a> u', "t u"), ("it's 5 < 6 and 7 > 6", "it's 5 < 6 and 7 > 6"),
    ('<p">quote</p>', "quote"), ("<p>open <b", "open <b"), ("<!doctype html><p>a<!-- <p>no --></p>", "a"), ("<p>a<!-- no", "a"),
    ("<script>if (a<b && c=\"x>\") {}</script><p>after</p>", "after"), ("<p>x<math><mi>y</mi></math><object>fallback</object></p>", "xyfallback")])
def test_tags(page, want):
    assert main_text.main_text(page) == want


@pytest.mark.parametrize("piece", ['<p title="x>Two</p>', "<p title='x>a</p><p title=\"y>", "<div><b>", "<div></b>", "<!-- x", "<! ", '<a href="', "<svg>", "< <a"])
def test_broken_pages_take_linear_time(piece):
    page, start = "<p>start</p>" + piece * (1_000_000 // len(piece)), time.process_time()
    main_text.main_text(page)
    assert time.process_time() - start < 10
