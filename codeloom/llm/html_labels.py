"""A small labelled table of text blocks, from twenty-two pages as sites of different kinds build them.

Each page is a list of (label, HTML): 1 for what a reader came for, 0 for what stands around it.  ``{n}`` is n words.
The table's rows are what `html_text.features` makes of the pages, so that training and use see blocks alike.
"""

import re

_NAV = "<nav><ul><li><a href='/'>{1}</a></li><li><a href='/a'>{1}</a></li><li><a href='/b'>{2}</a></li><li><a href='/c'>{1}</a></li></ul></nav>"
_FOOT = "<footer><p>&copy; {4}</p><p><a href='/i'>{1}</a> | <a href='/p'>{2}</a></p></footer>"
PAGES = [
    # a newspaper's article
    [(0, "<head><title>{9}</title></head>"), (0, _NAV), (1, "<h1>{9}</h1>"), (0, "<div>{3}</div>"), (1, "<p>{34}</p><p>{58}</p><p>{41} <a href='/x'>{2}</a> {22}</p><h2>{4}</h2><p>{66}</p><p>{29}</p>"), (0, "<div><a href='/s'>{1}</a> <a href='/t'>{1}</a></div>"), (0, "<h3>{2}</h3><ul><li><a href='/1'>{8}</a></li><li><a href='/2'>{9}</a></li><li><a href='/3'>{7}</a></li></ul>"), (0, "<footer><p>{11}</p><p>&copy; {3}</p></footer>")],
    # a weblog's entry with comments
    [(0, "<head><title>{6}</title></head>"), (0, "<div><a href='/'>{3}</a></div><div>{6}</div>"), (1, "<h2>{6}</h2>"), (0, "<div>{2} <a href='/u'>{2}</a></div>"), (1, "<p>{72}</p><p>{95} <a href='/l'>{3}</a> {31}</p><p>{18}</p><blockquote>{27}</blockquote><p>{80}</p>"), (0, "<div><a href='/k'>{1}</a> <a href='/m'>{1}</a> <a href='/n'>{2}</a></div>"), (1, "<div>{24}</div>"), (0, "<div>{2} <a href='/r'>{1}</a></div>"), (1, "<div>{39}</div>"), (0, "<div>{3} <a href='/r'>{1}</a></div>"), (0, "<ul><li><a href='/2019'>{2}</a></li><li><a href='/2018'>{2}</a></li></ul>"), (0, _FOOT)],
    # a shop's product
    [(0, "<head><title>{7}</title></head>"), (0, "<div><a href='/'>{1}</a></div><div><a href='/cart'>{2}</a></div>" + _NAV), (0, "<div><a href='/c'>{1}</a> &gt; <a href='/d'>{2}</a></div>"), (1, "<h1>{6}</h1>"), (0, "<div>{2}</div><div>{3}</div>"), (1, "<p>{47}</p><p>{36}</p>"), (0, "<div><a href='/buy'>{3}</a></div>"), (0, "<h3>{4}</h3><div><a href='/p1'>{4}</a></div><div>{1}</div><div><a href='/p2'>{5}</a></div><div>{1}</div>"), (0, "<footer><div>{9} <a href='/t'>{2}</a></div><div>{6}</div></footer>")],
    # documentation of a program
    [(0, "<head><title>{5}</title></head>"), (0, "<div><a href='/'>{1}</a></div><ul><li><a href='/g'>{2}</a></li><li><a href='/h'>{3}</a></li><li><a href='/j'>{1}</a></li><li><a href='/q'>{2}</a></li></ul>"), (1, "<h1>{4}</h1><p>{28}</p><h2>{2}</h2><p>{43} <a href='/w'>{1}</a> {17}</p><pre>{19}</pre><p>{31}</p><h2>{3}</h2><p>{52}</p><pre>{26}</pre>"), (0, "<div><a href='/prev'>{3}</a></div><div><a href='/next'>{2}</a></div>"), (0, "<footer>{5} <a href='/v'>{2}</a></footer>")],
    # an encyclopaedia's entry
    [(0, "<head><title>{3}</title></head>"), (0, "<ul><li><a href='/m'>{2}</a></li><li><a href='/r'>{2}</a></li><li><a href='/e'>{1}</a></li></ul>"), (1, "<h1>{2}</h1>"), (0, "<div>{5}</div>"), (1, "<p>{38} <a href='/1'>{2}</a> {26} <a href='/2'>{1}</a> {31}</p><p>{44} <a href='/3'>{3}</a> {52}</p><h2>{1}</h2><p>{60} <a href='/4'>{2}</a> {19}</p><p>{84}</p>"), (0, "<h2>{2}</h2><ul><li><a href='/s1'>{6}</a></li><li><a href='/s2'>{9}</a></li><li><a href='/s3'>{5}</a></li></ul>"), (0, "<footer><div>{12}</div><div>{14} <a href='/l'>{4}</a></div></footer>")],
    # a recipe
    [(0, "<head><title>{6}</title></head>"), (0, _NAV), (1, "<h1>{4}</h1><p>{33}</p>"), (0, "<div>{3}</div><div>{2}</div>"), (1, "<h3>{1}</h3><ul><li>{4}</li><li>{3}</li><li>{5}</li><li>{4}</li></ul><h3>{1}</h3><p>{45}</p><p>{38}</p><p>{22}</p>"), (0, "<div><a href='/pin'>{1}</a> <a href='/print'>{1}</a></div><h4>{3}</h4><div><a href='/r1'>{3}</a></div><div><a href='/r2'>{4}</a></div>"), (0, _FOOT)],
    # a forum's thread
    [(0, "<head><title>{8}</title></head>"), (0, "<div><a href='/f'>{1}</a> <a href='/s'>{1}</a> <a href='/l'>{1}</a></div>"), (1, "<h2>{8}</h2>"), (0, "<div><a href='/u1'>{1}</a></div><div>{4}</div>"), (1, "<div>{54}</div><div>{21}</div>"), (0, "<div><a href='/q'>{1}</a></div><div><a href='/u2'>{1}</a></div><div>{4}</div>"), (1, "<div>{87}</div>"), (0, "<div><a href='/q'>{1}</a></div><div><a href='/u3'>{1}</a></div><div>{4}</div>"), (1, "<div>{30}</div>"), (0, "<div><a href='/p'>{1}</a> <a href='/n'>{1}</a></div><div>{8}</div><div>{3} <a href='/z'>{1}</a></div>")],
    # a front page of teasers: nothing of it is a text of its own
    [(0, "<head><title>{4}</title></head>"), (0, _NAV + _NAV), (0, "<h2><a href='/1'>{8}</a></h2><p>{13} <a href='/1'>{2}</a></p><h2><a href='/2'>{7}</a></h2><p>{12} <a href='/2'>{2}</a></p><h2><a href='/3'>{9}</a></h2><p>{11} <a href='/3'>{2}</a></p>"), (0, "<h3>{2}</h3><ul><li><a href='/4'>{6}</a></li><li><a href='/5'>{8}</a></li><li><a href='/6'>{5}</a></li></ul>"), (0, "<div>{7}</div><div><a href='/n'>{3}</a></div>"), (0, _FOOT)],
    # a question and its answers
    [(0, "<head><title>{11}</title></head>"), (0, _NAV), (1, "<h1>{11}</h1>"), (0, "<div>{2}</div>"), (1, "<p>{46}</p><pre>{15}</pre><p>{17}</p>"), (0, "<ul><li><a href='/t1'>{1}</a></li><li><a href='/t2'>{1}</a></li></ul><div>{3} <a href='/a1'>{1}</a></div><h2>{2}</h2>"), (1, "<p>{68}</p><p>{32}</p>"), (0, "<div>{3} <a href='/a2'>{1}</a></div>"), (1, "<p>{25}</p><pre>{20}</pre><p>{41}</p>"), (0, "<div>{2} <a href='/a3'>{1}</a></div><h4>{2}</h4><ul><li><a href='/q1'>{9}</a></li><li><a href='/q2'>{8}</a></li></ul>"), (0, _FOOT)],
    # an institution's page
    [(0, "<head><title>{5}</title></head>"), (0, "<div><a href='/skip'>{3}</a></div>" + _NAV), (1, "<h1>{3}</h1><p>{26}</p><p>{49}</p>"), (0, "<div>{4}</div><div>{6}</div><div><a href='/map'>{2}</a></div>"), (0, "<ul><li><a href='/s1'>{2}</a></li><li><a href='/s2'>{3}</a></li></ul>"), (0, "<footer><p>{10}</p><p>{6}</p><p><a href='/acc'>{1}</a></p></footer>")],
    # a story in chapters: long paragraphs and short lines of speech
    [(0, "<head><title>{4}</title></head>"), (0, "<div><a href='/b'>{2}</a></div>"), (1, "<h2>{2}</h2><p>{130}</p><p>{9}</p><p>{6}</p><p>{75}</p><p>{4}</p><p>{11}</p><p>{98}</p><p>{13}</p><p>{7}</p><p>{110}</p>"), (0, "<div><a href='/c1'>{2}</a> <a href='/c3'>{2}</a></div>"), (0, "<div>{9}</div>")],
    # a minimal page
    [(0, "<head><title>{3}</title></head>"), (1, "<p>{55}</p><p>{40}</p><p>{63}</p>"), (0, "<p>{2} <a href='/h'>{1}</a></p>")],
    # a gallery: captions of a few words, no text
    [(0, "<head><title>{3}</title></head>"), (0, _NAV), (0, "<h1>{3}</h1><div><a href='/g1'>{2}</a></div><div>{3}</div><div><a href='/g2'>{3}</a></div><div>{4}</div><div><a href='/g3'>{2}</a></div><div>{3}</div>"), (0, "<div>{8}</div>"), (0, _FOOT)],
    # an article with an advertisement and a notice in its middle
    [(0, "<head><title>{8}</title></head>"), (0, "<div>{13} <a href='/cookie'>{2}</a></div><div><a href='/ok'>{1}</a></div>" + _NAV), (1, "<h1>{8}</h1><p>{62}</p><p>{48}</p>"), (0, "<div>{1}</div><div><a href='/ad'>{6}</a></div>"), (1, "<p>{57}</p><p>{71}</p>"), (0, "<div>{9} <a href='/sub'>{3}</a></div>"), (1, "<p>{36}</p><p>{19}</p>"), (0, "<h3>{3}</h3><div><a href='/m1'>{10}</a></div><div><a href='/m2'>{8}</a></div>"), (0, "<footer><div>{15}</div><div>&copy; {5}</div></footer>")],
    # plain pages whose text is followed by a line of copyright alone
    [(0, "<head><title>{4}</title></head>"), (0, "<div><a href='/'>{1}</a></div>"), (1, "<h1>{4}</h1><p>{70}</p><p>{44}</p>"), (0, "<footer>{5}</footer>")],
    [(0, "<head><title>{6}</title></head>"), (0, "<div><a href='/h'>{1}</a> <a href='/k'>{1}</a></div>"), (1, "<p>{31}</p><p>{93}</p><p>{26}</p>"), (0, "<div>{8}</div>")],
    [(0, "<head><title>{5}</title></head>"), (1, "<h2>{5}</h2><p>{120}</p><p>{88}</p><p>{54}</p>"), (0, "<div>{11}</div>")],
    [(0, "<head><title>{7}</title></head>"), (0, _NAV), (1, "<h1>{7}</h1><p>{52}</p><p>{37}</p>"), (0, "<footer>{9}</footer>")],
    # an index of topics, and an article beside a cloud of them
    [(0, "<head><title>{3}</title></head>"), (0, _NAV), (0, "<h1>{2}</h1><div><a href='/t1'>{24}</a></div><div><a href='/t2'>{41}</a> {3}</div><div>{4} <a href='/t3'>{33}</a></div><div><a href='/t4'>{19}</a></div>"), (0, _FOOT)],
    [(0, "<head><title>{8}</title></head>"), (1, "<h1>{8}</h1><p>{64}</p><p>{39} <a href='/w'>{3}</a> {20}</p>"), (0, "<div><a href='/tags'>{28}</a></div><div><a href='/all'>{52}</a></div>"), (0, _FOOT)],
    # a results page and a page not found
    [(0, "<head><title>{4}</title></head>"), (0, _NAV), (0, "<div>{5}</div><div><a href='/r1'>{7}</a></div><div>{16}</div><div><a href='/r2'>{6}</a></div><div>{15}</div><div><a href='/r3'>{9}</a></div><div>{14}</div>"), (0, "<div><a href='/p1'>{1}</a> <a href='/p2'>{1}</a></div>"), (0, _FOOT)],
    [(0, "<head><title>{3}</title></head>"), (0, "<h1>{3}</h1><p>{9}</p><p><a href='/'>{4}</a></p>")],
]


def fill(html: str) -> str:
    return re.sub(r"\{(\d+)\}", lambda m: " ".join(["word"] * int(m[1])), html)
