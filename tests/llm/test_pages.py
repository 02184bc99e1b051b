"""The block labeller on pages written and labelled by hand, in shapes that its training rules don't make, and the parser's odd cases.

Every block begins with its label: [+] main text, [-] anything else, [?] either is right (bylines and the like).
"""

import re

import pytest

from tarn.llm import blocks, extract

BLOG = """<!doctype html><html lang="en-US"><head><meta charset=utf-8><title>Sourdough</title><link rel=stylesheet href=a.css></head>
<body class="post-template-default single single-post postid-31"><div id="page" class="hfeed site"><a class="skip-link" href="#c">[-]Skip to content</a>
<header id="masthead" class="site-header"><h1 class="site-title"><a href="/">[-]The Slow Oven</a></h1><p class="site-description">[-]Bread, patience and a little flour on everything</p>
<nav id="site-navigation" class="main-navigation"><ul id="primary-menu"><li class="menu-item"><a href=/>[-]Home</a></li><li class="menu-item"><a href=/r>[-]Recipes</a></li><li class="menu-item"><a href=/a>[-]About me</a></li></ul></nav></header>
<div id="content" class="site-content"><div id="primary" class="content-area"><main id="main" class="site-main"><article id="post-31" class="post type-post status-publish">
<header class="entry-header"><h1 class="entry-title">[+]Why my starter finally woke up</h1><div class="entry-meta"><span class="posted-on">[?]Posted on March 3 by Ines</span></div></header>
<div class="entry-content"><p>[+]For three weeks nothing happened. I fed it twice a day, kept it near the heater, and talked to it more than I would like to admit.</p>
<p>[+]Then I changed a single thing: the water. Our tap water is treated, and the jar simply did not like it.</p><h2>[+]What I do now</h2>
<ul><li>[+]Let the water stand overnight</li><li>[+]Use rye for every second feeding</li><li>[+]Throw away less than the books say</li></ul>
<blockquote><p>[+]A starter is a pet that you are allowed to eat.</p></blockquote><p>[+]It has doubled every day since, and the crust has never been better.</p></div>
<footer class="entry-footer"><span class="tags-links">[-]Tagged bread, sourdough</span></footer></article>
<nav class="navigation post-navigation"><div class="nav-previous"><a href=x>[-]Older: my broken scale</a></div><div class="nav-next"><a href=y>[-]Newer: salt</a></div></nav>
<div id="comments" class="comments-area"><h2 class="comments-title">[-]2 thoughts on this post</h2><ol class="comment-list"><li class="comment even"><article class="comment-body"><b class="fn">[-]Tom</b><div class="comment-content"><p>[-]Same here, the chlorine killed mine as well. Thanks for writing this up!</p></div><div class="reply"><a href=r>[-]Reply</a></div></article></li>
<li class="comment odd"><article class="comment-body"><b class="fn">[-]Ada</b><div class="comment-content"><p>[-]I use bottled water and never looked back.</p></div></article></li></ol>
<div id="respond" class="comment-respond"><h3 id="reply-title">[-]Leave a Reply</h3><form id="commentform"><label>[-]Comment</label><textarea></textarea><button>[-]Post Comment</button></form></div></div></main></div>
<aside id="secondary" class="widget-area"><section class="widget widget_recent_entries"><h2 class="widget-title">[-]Recent Posts</h2><ul><li><a href=1>[-]My broken scale</a></li><li><a href=2>[-]Salt, and why I weigh it</a></li></ul></section></aside></div>
<footer id="colophon" class="site-footer"><div class="site-info">[-]Proudly powered by hand. &copy; 2021 The Slow Oven</div></footer></div></body></html>"""

NEWS = """<html><body><div class="cookie-consent" role="dialog"><p>[-]We and our partners store information on your device.</p><button>[-]Accept all</button></div>
<div class="topbar"><div class="wrap"><a href=/>[-]The Harbour Gazette</a></div><ul class="topnav"><li><a>[-]News</a><li><a>[-]Sport</a><li><a>[-]Weather</a></ul></div>
<div role="main" class="story-page"><h1 class="headline">[+]Ferry returns after winter repairs</h1><p class="standfirst">[+]The island's only ferry sailed again on Monday, two months later than planned.</p>
<p>[+]Passengers waved from the upper deck as the vessel left the quay shortly after seven in the morning.</p>
<div class="ad ad-inline">[-]Advertisement: book your summer crossing today</div>
<p>[+]The yard had found more rust than expected, the harbour master said, and steel was hard to get.</p>
<div class="related-links"><h4>[-]More on this</h4><ul><li><a>[-]Islanders ask for a second ship</a></li><li><a>[-]How the ferry was built</a></li></ul></div>
<p>[+]"We missed the sound of the horn," said a baker who sends her bread across every day.</p><p>[+]Tickets cost the same as before.</p></div>
<div class="newsletter-signup"><p>[-]Get the morning briefing in your inbox.</p><form><input name=e><button>[-]Sign up</button></form></div>
<div class="share-bar"><a>[-]Share</a></div><footer><p>[-]&copy; Harbour Media Group</p><ul><li><a>[-]Terms of use</a></li><li><a>[-]Privacy</a></li></ul></footer></body></html>"""

TABLES = """<HTML><BODY BGCOLOR="#ffffff"><TABLE WIDTH=760><TR><TD COLSPAN=2 CLASS=header><FONT SIZE=5>[-]Bob's Radio Pages</FONT></TD></TR>
<TR><TD WIDTH=140 VALIGN=top CLASS=menu><A HREF=index.html>[-]Start</A><BR><A HREF=links.html>Links</A><BR><A HREF=guest.html>Guestbook</A></TD>
<TD VALIGN=top><H1>[+]Restoring a valve receiver</H1><P>[+]I bought this set at a flea market for the price of a sandwich. The case was cracked and two valves were missing.
<P>[+]First I cleaned the chassis with a soft brush. Do not use water, and never plug in a set whose capacitors have not been checked.
<P>[+]The output transformer was fine, so only the paper capacitors had to go.</TD></TR>
<TR><TD COLSPAN=2 CLASS=footer><FONT SIZE=1>[-]Last updated 1999. Best viewed at 800 x 600.</FONT></TD></TR></TABLE></BODY></HTML>"""

DOCS = """<!DOCTYPE html><html><head><title>x</title></head><body><header class="navbar"><a href=/>[-]libqueue</a><form class="search"><label>[-]Search the docs</label><input></form></header>
<div class="container"><nav class="toc sidebar"><ul><li><a href=#a>[-]Install</a></li><li><a href=#b>[-]Usage</a></li><li><a href=#c>[-]Changes</a></li></ul></nav>
<main><h1>[+]Queues</h1><p>[+]A queue keeps its entries in the order in which they were added.</p><h2 id=a>[+]Install</h2><pre>[+]make
make install</pre><h2 id=b>[+]Usage</h2><p>[+]Create a queue, push to it, and read from the other end:</p><pre><code>[+]q = queue_new(16); queue_push(q, item);</code></pre>
<table><tr><th>[+]Call</th><th>[+]Meaning</th></tr><tr><td>[+]queue_push</td><td>[+]adds an entry, waits if there is no room</td></tr></table><p>[+]All calls may be made from several threads.</p></main></div>
<footer class="footer"><p>[-]Built with plain HTML. Report a problem on the tracker.</p></footer></body></html>"""

GERMAN = """<html lang=de><body><div id="kopf" class="header"><div class="logo">[-]Gartenblog</div><ul class="menu"><li>[-]Startseite<li>[-]Über mich<li>[-]Kontakt</ul></div>
<div id="inhalt" class="content"><div class="post"><h2 class="post-title">[+]Tomaten im Regen</h2><div class="post-body"><p>[+]In diesem Sommer hat es fast jeden Tag geregnet, und die Tomaten mochten das gar nicht.</p><p>[+]Ein Dach aus alten Fenstern hat geholfen. Die Blätter blieben trocken, und die Braunfäule kam erst im September.</p>
<p>[+]Nächstes Jahr baue ich es größer.</p></div></div><div class="comments"><h4>[-]3 Kommentare</h4><div class="comment"><p>[-]Bei mir war es genauso, leider ohne Dach.</p></div><div class="comment"><p>[-]Schöne Idee!</p></div></div></div>
<div class="sidebar"><h3>[-]Archiv</h3><ul><li><a>[-]August</a><li><a>[-]Juli</a></ul></div><div class="footer">[-]Impressum | Datenschutz</div></body></html>"""

BARE = """<html><body><p>[-]<a href=/>Home</a> | <a href=/n>Notices</a> | <a href=/c>Contact</a></p><h1>[+]Closure of the north footbridge</h1>
<p>[+]The footbridge over the canal will be closed from Monday for four weeks while its handrails are replaced.</p><p>[+]Pedestrians are asked to use the road bridge, which is a short walk to the west.</p>
<p>[+]Work takes place between eight and five. We apologise for the noise.</p><hr><footer>[-]Town Council, Market Square</footer></body></html>"""

HASHED = """<html><body><div id=root><div class="css-1x2f"><div class="css-9k"><nav class="css-77"><a>[-]Sign in</a> <a>Get started</a></nav></div><div class="css-3a"><article class="css-5b"><section class="css-0"><div><h1 class="css-t">[+]What I learned from deleting my notes</h1>
<div><p class="css-p">[+]Last month a sync error removed four years of notes, and I was surprised by how calm I felt.</p><p class="css-p">[+]Most of what I wrote down was never read again. The few things that mattered were in my head, or in letters to friends.</p><figure><img src=a><figcaption>[+]An empty notebook on a table</figcaption></figure>
<h2>[+]Keeping less</h2><p class="css-p">[+]So now I write things down to think, and then let them go.</p></div></div></section></article><div class="css-8 related"><h3>[-]Recommended</h3><div><a>[-]The case for paper</a></div><div><a>[-]Ten ways to sync</a></div></div></div>
<div class="css-f footer"><a>[-]Help</a> <a>Status</a> <a>Privacy</a></div></div></div></body></html>"""

RECIPE = """<html><body><header><div class=brand>[-]Kitchen Table</div><nav><a>[-]Soups</a> <a>Cakes</a></nav></header><div class="breadcrumb">[-]Home &gt; Soups &gt; Lentil</div>
<main class="recipe"><h1>[+]Red lentil soup</h1><p>[+]A soup for the evening when the cupboard is nearly empty.</p><h3>[+]Ingredients</h3><ul><li>[+]200 g red lentils</li><li>[+]1 onion, chopped</li><li>[+]1 tin of tomatoes</li></ul>
<h3>[+]Method</h3><ol><li>[+]Fry the onion until soft, then add the lentils and a litre of water.</li><li>[+]Add the tomatoes and simmer for twenty minutes.</li><li>[+]Blend half of it and season well.</li></ol>
<div class="promo">[-]Try our new cookbook, out now</div><p>[+]It keeps for three days in the fridge.</p></main><section class="comments" id=discussion><h3>[-]Comments</h3><p>[-]Made this last night with cumin, lovely.</p></section>
<div class="social share"><a>[-]Share on everything</a></div><footer>[-]&copy; Kitchen Table &middot; All rights reserved</footer></body></html>"""

PAGES = {"blog": BLOG, "news": NEWS, "tables": TABLES, "docs": DOCS, "german": GERMAN, "bare": BARE, "hashed": HASHED, "recipe": RECIPE}
MARK = re.compile(r"\[([+?-])\]")


def labelled(page):
    found = blocks.parse(page)
    labels = [(MARK.search(b.text) or [None, "?"])[1] for b in found]
    for b in found:
        b.text = MARK.sub("", b.text)
    return found, labels


def test_labeller_on_hand_labelled_pages():
    right = total = 0
    wrong = []
    for name, page in PAGES.items():
        found, labels = labelled(page)
        assert labels.count("+") == page.count("[+]") and labels.count("-") == page.count("[-]"), name
        main = extract.main_texts([found])[0].split("\n")
        for b, label in zip(found, labels, strict=True):
            if label != "?":
                ok = (b.text in main) == (label == "+")
                total += 1
                right += ok
                wrong += [] if ok else [(name, label, b.text)]
    print(f"{right} of {total} blocks", wrong)
    assert right >= 0.93 * total, wrong


def texts(page):
    return [b.text for b in blocks.parse(page)]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p title=it's>hello world</p><p>please don't stop</p><p>third</p>", ["hello world", "please don't stop", "third"]),
        ('<a href=/x?a="b>one</a> <p class = "c>d">two', ["one", "two"]),
        ('<p title="never closed>one</p>two', ["one", "two"]),
        ("<!-->a<!--->b<!-- <p>no</p> -->c", ["abc"]),
        ("<html><head><title>t</title><div>no body tag</div>tail", ["no body tag", "tail"]),
        ("<head><meta x>text ends the head<p>b", ["text ends the head", "b"]),
        ("<div class=article><table><tr><td>c1</div> c2<td>c3<tr><td>c4</table><p>after</p></div>", ["c1", "c2", "c3", "c4", "after"]),
        ("<h2>a</h3>b<h2>c<h3>d</h2>e", ["a", "b", "c", "d", "e"]),
        ("<p>end <b", ["end"]),
        ("1 < 2 <- x", ["1 < 2 <- x"]),
    ],
)
def test_parser_loses_no_text(page, want):
    assert texts(page) == want


@pytest.mark.parametrize("depth", [0, 30, 500, 3000])
def test_parser_at_any_depth(depth):
    page = "<div>" * depth + "<noscript>hid</noscript><svg>pic</svg>shown<section class=comments><p>said</p></section>" + "</div>" * depth
    found = blocks.parse(page)
    assert [b.text for b in found] == ["shown", "said"]
    assert blocks._KEY_AT["comments"] in found[1].path and blocks._KEY_AT["comments"] not in found[0].path
