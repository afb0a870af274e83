"""Invented pages whose blocks are the labelled table of the main-text classifier.

A block of main text begins with ``*``; ``{n}`` stands for n words of a passage.
"""

from __future__ import annotations

import re

PASSAGE = (
    "The harbour was quiet when the first boats came back and the traders opened their sheds to weigh the morning catch "
    "while two clerks wrote down what each crew had brought in and what the buyers from the valley would pay for it that day"
).split()

_NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">World news</a></li><li><a href="/s">Sport</a></li><li><a href="/c">Contact</a></li></ul></nav>'
_LINKS = '<div><a href="/">Home</a></div><div><a href="/n">News</a> <a href="/s">Sport</a></div><div><a href="/a">About us</a></div>'
_RELATED = '<ul><li><a href="/1">{6}</a></li><li><a href="/2">{8}</a></li><li><a href="/3">{5}</a></li></ul>'

PAGES = (
    # an article element between furniture of all lengths
    _NAV + '<div class="ad">{9}</div><article><h1>*{7}</h1><p>*{40}</p><p>*{1}</p><p>*{55} <a href="/x">{4}</a></p></article><footer>&copy; Example {9}</footer>',
    _NAV + '<div class="advert">{60}</div><article><h1>*{3}</h1><p>*{2}</p></article><footer>{35}</footer>',
    '<header><div>{12}</div></header><article><h2>*{5}</h2><p>*{90}</p><p>*{14}</p></article><footer><p>{60}</p><p>{4}</p></footer>',
    '<div class="ad">{3}</div><article><h1>*{9}</h1><p><b>*{21}<br>{3}</p><p>*{1}</p><p>*{6}</p></article><footer>&copy; Example {40}</footer>',
    _NAV + '<article><h1>*{6}</h1><p>*{18}</p><aside>{30}</aside><p>*{33}</p><div class="promo">{14} <a href="/b">{3}</a></div><p><a href="/l">*{5}</a></p><ul><li>*{12}</li><li>*{3} <a href="/m">{3}</a></li><li>*{1}</li></ul></article>',
    _NAV + '<article><h1>*{11}</h1><p><a href="/x">*{1}</a></p><p><a href="/x">*{16}</a></p><p>*{2} <a href="/y">{2}</a></p><blockquote>*{24}</blockquote></article><aside>{50}</aside><footer>{2}</footer>',
    '<nav>{3}</nav><article><p>*{60}</p><p>*{1}</p><p>*{85}</p><p>*{1}</p><p>*{2}</p><p>*{47}</p><p>*{1}</p></article><footer>&copy; Example</footer>',
    '<article><p>*{19}</p><p>*{1}</p></article>' + _NAV + '<article><p>*{1}</p><p>*{37}</p><p>*{1}</p></article><footer>' + _LINKS + '</footer>',
    # words of notices within an article are its subject
    '<article><h1>*Why sites ask to use cookies</h1><p>*{20} privacy policy {25}</p><p>*{30} all rights reserved {10}</p><p>*Subscribe to our {3}</p></article><footer>All rights reserved</footer><div class="cookie-notice">We use cookies {20}</div>',
    # reader comments, forms, notices, a sidebar; in the article and beside it
    '<article><p>*{50}</p><p>*{45}</p><div class="comments"><h3>{2}</h3><p>{48}</p><p>{60}</p><form>{3} <button>{1}</button></form></div></article>' + '<div id="sidebar"><p>{70} <a href="/q">{9}</a></p>' + _RELATED + '</div>',
    '<main><h1>*{8}</h1><p>*{26}</p><div class="newsletter">{17}</div><p>*{31}</p></main><div class="cookie-banner">{25}</div><div role="contentinfo">{28}</div>',
    '<div class="menu">{2}</div><div class="post"><h2>*{4}</h2><div>*{22}</div><div>*{64}</div></div><div class="related">' + _RELATED + '</div><div class="sponsored">{44}</div>',
    '<dialog>{33}</dialog><div role="main"><p>*{12}</p><p>*{28} <a href="/z">{2}</a></p><p>*{9}</p></div><section class="comments"><p>{5}</p><p>{80}</p></section>',
    '<nav><p>{30}</p></nav><header>{14}</header><article><h1>*{2}</h1><p>*{1}</p><p>*{1}</p></article><aside><p>{1}</p></aside><footer><p>{90}</p></footer>',
    # furniture alone
    _NAV + '<header><h1>{3}</h1></header><aside><p>{40}</p></aside><form>{9}</form><footer><p>{18}</p></footer>',
    # names that tell nothing: long text between short linked blocks
    _LINKS + '<h1>*{6}</h1><div>*{42}</div><div>*{60} <a href="/x">{6}</a></div><div>*{18}</div><div>*{11} <a href="/x">{9}</a></div><div>*{5}</div><div>*{38}</div>' + _LINKS,
    _LINKS + '<h1>*{4}</h1><p>*{30}</p><h3>*{3}</h3><p>*{25}</p><p>*{70}</p><p>*{12} <a href="/x">{6}</a> {14}</p>' + _RELATED + '<div>Copyright 2020 Example Ltd, all rights reserved</div>',
    _LINKS + '<div>{2}</div><h2>*{9}</h2><p>*{55}</p><p>*{4}</p><p>*{48}</p><div>{1}</div><div><a href="/p">Previous</a> <a href="/n">Next</a></div><div>{2}</div>' + _RELATED,
    '<p>We use cookies to make this site work. <a href="/ok">Accept</a></p>' + _LINKS + '<h1>*{5}</h1><p>*{33}</p><p>*{1}</p><p>*{29}</p><p>*{61}</p><p>Copyright Example, all rights reserved.</p>',
    '<div>This site uses cookies. By staying you agree to our privacy policy and our terms of use.</div><div>*{24}</div><div>*{47}</div><div>*{3}</div><div>*{36}</div><div>&copy; 2019 Example Trust. {5}</div>',
    _LINKS + '<table><tr><td>{2}</td><td><a href="/t">{2}</a></td></tr></table><p>*{44}</p><ul><li>*{9}</li><li>*{7}</li><li>*{11}</li></ul><p>*{20}</p>' + _RELATED + '<p>Sign up for our newsletter</p>',
    _LINKS + '<div>{1}</div>' + _RELATED + '<div>{3}</div>' + _RELATED + '<div>{2}</div><div>Terms of use</div>',
    _RELATED + '<div>{4}</div>' + _RELATED + '<div>{2} <a href="/m">{1}</a></div><div>{5}</div>' + _LINKS,
    '<div><a href="/">{2}</a></div><h1>*{12}</h1><div>*{15}</div><div>*{90}</div><div>*{2}</div><div>*{17}</div><div>Share this: <a href="/f">{1}</a> <a href="/g">{1}</a></div><div>{2}</div><div><a href="/a">{7}</a></div>',
    '<h1>*{5}</h1><p>*{23}</p><p>*{16}</p><p>*{8}</p><p>*{41}</p>',
    '<p>*{35}</p>',
    '<p>*{3}</p><p>*{28}</p>' + _LINKS,
    _LINKS + '<div>{3}</div><div><a href="/r">{9}</a></div><div>{2}</div><div><a href="/u">{11}</a></div><div>{1}</div>',
)


def page(form: str) -> str:
    """The page of a form, its main blocks marked with ``*``."""
    return re.sub(r"\{(\d+)\}", lambda m: " ".join(PASSAGE[k % len(PASSAGE)] for k in range(int(m[1]))), form)
