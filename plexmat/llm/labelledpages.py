"""Labelled training pages for HTML extraction: ``data-content`` marks what is main text (1) and what isn't (0)."""

_A = "The council met on Tuesday to discuss the new bridge, which has been closed since spring. "
_B = "Several members asked for a report before any money is spent, and the mayor agreed to publish it. "
_C = "Work may start again in autumn if the weather holds. "
_SHORT = "It was a long day."
_NAV = '<ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">Contact</a></li></ul>'

LABELLED_PAGES: list[str] = [
    f"""<html><body><nav data-content="0">{_NAV}</nav><div class="ad" data-content="0">Buy one, get one free today.</div>
<article data-content="1"><h1>Bridge stays closed</h1><p>{_A * 3}</p><p>{_SHORT}</p><p>{_B * 2}</p><blockquote>{_C}</blockquote></article>
<footer data-content="0">&copy; example.org &middot; All rights reserved</footer></body></html>""",
    f"""<html><body><header data-content="0"><div class="logo">The Daily Sample</div><p>Your local paper since 1950.</p></header>
<nav class="menu" data-content="0">{_NAV}</nav>
<main data-content="1"><article><h1>Bridge stays closed</h1><p>{_A * 2}</p><h2>Background</h2><p>{_B * 3}</p><ul><li>{_C}</li><li>First point.</li></ul>
<section id="comments" class="comments" data-content="0"><h3>Comments</h3><div class="comment"><p>I think this is a very bad idea, to be honest.</p></div>
<div class="comment"><p>Agreed, they should have done it years ago.</p></div></section></article></main>
<aside class="sidebar" data-content="0"><h3>Related</h3><ul><li><a href="/1">Road works begin</a></li><li><a href="/2">New school opens</a></li></ul><p>Most read stories of the week.</p></aside>
<footer class="footer" data-content="0"><p>Copyright 2020 The Daily Sample. All rights reserved.</p>{_NAV}</footer></body></html>""",
    f"""<html><body><div id="header" data-content="0"><h2>My site</h2><p>A blog about things.</p></div><div id="menu" data-content="0">{_NAV}</div>
<div class="cookie-notice" data-content="0"><p>We use cookies to give you the best experience on our website. By continuing you agree to this.</p><button>Accept</button></div>
<div id="content" data-content="1"><div class="post"><h1>A walk in the hills</h1><p>{_C * 4}</p><p>{_A}</p><div class="share" data-content="0">Share this: <a href="#">Mail</a></div><p>{_B * 2}</p></div></div>
<div id="sidebar" data-content="0"><div class="widget"><h3>Archive</h3>{_NAV}</div><div class="widget"><p>About the author: writes on weekends.</p></div></div>
<div id="footer" data-content="0">Powered by nothing. Contact us.</div></body></html>""",
    f"""<html><body><div class="newsletter popup" data-content="0"><p>Sign up for our newsletter and never miss a story.</p><form><label>Mail</label><input name="m"></form></div>
<div class="wrapper"><div class="main-content" data-content="1"><h1>Report</h1><p>{_B}</p><p>{_A * 2}</p><table><tr><td>Year</td><td>Cost</td></tr><tr><td>2019</td><td>40</td></tr></table><p>{_C}</p></div>
<div class="advertisement" data-content="0"><p>Sponsored: the best shoes in town, now with free delivery.</p></div>
<form class="contact" data-content="0"><fieldset><label>Name</label><p>Please fill in all fields.</p></fieldset></form>
<div class="reader-comments" data-content="0"><ul><li><p>Thanks for the report, it was a good read.</p></li><li><p>Not true at all.</p></li></ul></div></div>
<div class="legal" data-content="0"><p>Terms of use and privacy policy apply to all visitors.</p></div></body></html>""",
    f"""<html><body><header data-content="0">{_NAV}</header><section data-content="1"><header><h1>On bread</h1><p>{_SHORT}</p></header><p>{_A * 4}</p><p>{_B}</p><pre>flour water salt</pre></section>
<div class="related" data-content="0"><a href="/x">Cakes and more</a> <a href="/y">Soups</a></div><div class="sponsor" data-content="0">Try our oven.</div><footer data-content="0"><address>12 Sample Street.</address></footer></body></html>""",
    f"""<html><body><div role="navigation" data-content="0"><a href="/">Start</a> <a href="/q">Search</a></div><div class="alert notice" data-content="0">The site will be down on Sunday night.</div>
<div role="main" data-content="1"><p>{_C * 2}</p><p>{_SHORT}</p><p>{_A}</p><p>{_B * 4}</p></div><div role="contentinfo" data-content="0"><p>Imprint.</p></div>
<div class="disqus thread" data-content="0"><p>{_SHORT} I liked it very much.</p><p>So did I, thanks for sharing.</p></div></body></html>""",
    f"""<html><body><nav data-content="0">{_NAV}</nav><div data-content="1"><h1>Plain page</h1><p>{_A * 3}</p><p>Short line</p><p>{_B * 3}</p><p>{_SHORT}</p></div><footer data-content="0">2021</footer></body></html>""",
    f"""<html><body data-content="1"><h1>Bare page</h1><p>{_A * 3}</p><p>{_B}</p><p>{_SHORT}</p><footer data-content="0">&copy; 2021 someone</footer></body></html>""",
]
