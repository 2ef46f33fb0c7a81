"""Readers' comments go, by name and by structure; what only looks like them stays."""

import pytest

from lectern.llm.html_text import main_text

BODY = [f"Paragraph {k} of the article tells, at some length, what happened that day, who was there, and why it matters to the town." for k in range(3)]
ARTICLE = "".join(f"<p>{p}</p>" for p in BODY)
SAID = [f"Remark {k}: I never agreed with any of this, and I said so at length before, as all of my neighbours, friends and cousins know, at least as well as I do." for k in range(8)]
REMARKS = "".join(f"<p>{p}</p>" for p in SAID)


@pytest.mark.parametrize("name", ["disqus_thread", "user-comments", "fb-comments", "reader-comments", "comment-thread", "comments-v2", "commentList", "post_comments"])
@pytest.mark.parametrize("attribute", ["id", "class"])
@pytest.mark.parametrize("inside", [True, False])
def test_names(name, attribute, inside):
    remarks = f'<div {attribute}="{name}">{REMARKS}</div>'
    page = f"<html><body><article>{ARTICLE}{remarks if inside else ''}</article>{'' if inside else remarks}</body></html>"
    assert main_text(page) == "\n".join(BODY)
    page = f'<html><body><div class="page"><div class="story">{ARTICLE}{remarks if inside else ""}</div>{"" if inside else remarks}</div></body></html>'
    assert main_text(page) == "\n".join(BODY)


@pytest.mark.parametrize("name", ["discussion", "responses", "section-7", ""])
@pytest.mark.parametrize("item", ['<div class="entry"><span class="user-name">Ann</span> <time>3 May</time><p>{}</p></div>', '<li><a class="author">Bo</a> <span class="date">today</span> {}</li>'])
def test_structure(name, item):
    remarks = f'<div class="{name}">' + "".join(item.format(s) for s in SAID) + "</div>"
    assert main_text(f"<html><body><div>{ARTICLE}</div>{remarks}</body></html>") == "\n".join(BODY)
    assert main_text(f"<html><body><article>{ARTICLE}{remarks}</article></body></html>") == "\n".join(BODY)


@pytest.mark.parametrize(
    "block,kept",
    [
        ("<ul>" + "".join(f"<li><time>{k} May</time> A talk on the history of the town, its bridges and its mills.</li>" for k in range(5)) + "</ul>", "A talk on the history"),
        ("".join(f'<div class="quote"><span class="author">Ann {k}</span><p>{s}</p></div>' for k, s in enumerate(SAID)), "Remark 7"),
        ('<div class="commentary">' + REMARKS + "</div>", "Remark 7"),
        ('<div class="story comment-page">' + REMARKS + "</div>", "Remark 7"),
        ('<div class="has-comments">' + REMARKS + "</div>", "Remark 7"),
    ],
)
def test_what_stays(block, kept):
    """A schedule has dates and no authors, quotations have authors and no dates; a state or a word of another meaning is no name of remarks."""
    text = main_text(f"<html><body><article>{ARTICLE}{block}</article></body></html>")
    assert text.startswith(BODY[0]) and kept in text


def test_a_list_of_posts_is_no_talk():
    posts = "".join(f'<div class="post"><h2>Title {k}</h2><span class="author">Ann</span><time>May</time><p>{s}</p></div>' for k, s in enumerate(SAID))
    assert "Remark 7" in main_text(f"<html><body><p>{' '.join(BODY)}</p><div>{posts}</div></body></html>")


def test_talk_without_an_article_stays():
    """A page that is nothing but a thread has no other text."""
    items = "".join(f'<div class="entry"><span class="user">Ann</span> <time>3 May</time><p>{s}</p></div>' for s in SAID)
    assert "Remark 7" in main_text(f"<html><body><div>{items}</div></body></html>")
