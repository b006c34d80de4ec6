"""The labelled table of the page classifier: ``page, fragment, label``, fragments in page order, label 1 for content."""

_P = "The harbour was quiet that morning and the first boats came in before the sun had cleared the hills behind the town."
_Q = "Nobody on the pier had expected the price of fish to rise so quickly, yet by noon the whole catch was sold."
_L = '<a href="/x">%s</a>'


def _menu(*names: str) -> str:
    return "<ul>" + "".join(f"<li>{_L % n}</li>" for n in names) + "</ul>"


LABELLED: list[tuple[str, str, int]] = [
    # an article between a menu and a footer
    ("news", f"<html><head><title>x</title></head><body><nav>{_menu('Home', 'World', 'Sports', 'Local news')}</nav>", 0),
    ("news", '<div class="ad">Buy two lamps and get the third one for free today.</div>', 0),
    ("news", "<article><h1>Boats return</h1>", 1),
    ("news", f"<p>{_P}</p><p>Yes.</p><p>{_Q}</p>", 1),
    ("news", "<h2>What next</h2><ul><li>Repairs</li><li>New nets and ropes</li></ul>", 1),
    ("news", f'<p>{_L % "More figures"} are on file.</p><p>{_Q}</p></article>', 1),
    ("news", "<footer>&copy; Harbour Post, all rights reserved and so on for ever.</footer></body></html>", 0),
    # short paragraphs in an article, long texts beside it
    ("blog", "<header><p>Notes from a small harbour by the sea, since long ago</p></header>", 0),
    ("blog", f'<nav>{_menu("About", "Archive")}</nav><div id="sidebar"><p>{_P}</p>{_menu("One", "Two")}</div>', 0),
    ("blog", f"<main><h1>Rope</h1><p>Knots.</p><p>Short line.</p><p>{_P}</p><blockquote>Hold fast.</blockquote>", 1),
    ("blog", f'<div class="related">{_menu("Other boats", "Other nets")}</div>', 0),
    ("blog", "<p>The end.</p></main>", 1),
    ("blog", f'<section class="comments"><p>I liked this text very much, thank you for it.</p><p>{_Q}</p></section>', 0),
    ("blog", "<form><p>Leave a reply here</p><label>Name</label></form><footer><p>Imprint and contact of the owner of this site</p></footer>", 0),
    # notices and adverts inside the article
    ("shop", f'<div class="cookie-notice"><p>We use cookies to make this site work for you. {_Q}</p></div>', 0),
    ("shop", f'<div class="menu">{_menu("Start", "Prices")}</div>', 0),
    ("shop", f"<article><h1>Nets compared</h1><p>{_P}</p>", 1),
    ("shop", '<aside><p>Sponsored: the best nets you can buy this year, at a price you will like.</p></aside>', 0),
    ("shop", "<p>So much for cotton.</p><table><tr><th>Net</th><td>Strong</td></tr></table>", 1),
    ("shop", f"<p>{_L % 'All figures of the year'}</p><p>{_P} {_L % 'here'}</p><ul><li>{_L % 'Cotton'}</li><li>{_L % 'Hemp'}</li></ul>", 1),
    ("shop", '<div class="share">Share this page with friends</div>', 0),
    ("shop", f"<p>{_Q}</p></article>", 1),
    ("shop", "<footer><p>Prices with tax.</p><p>We ship to all countries of the world within three days.</p></footer>", 0),
    # pages without an element for the article: words and links of the neighbours decide
    ("plain", f"<div>{_L % 'Home'} | {_L % 'Contact'} | {_L % 'Map of the site'}</div>", 0),
    ("plain", f"<h1>Harbour report</h1><div>{_P}</div><div>{_Q} {_P}</div>", 1),
    ("plain", f"<p>{_P} {_L % 'table'}</p><p>{_Q}</p><p>{_P}</p>", 1),
    ("plain", f"<div>{_L % 'Next page'}</div><div>{_L % 'Top of this page'}</div>", 0),
    ("old", f"<table><tr><td>{_L % 'Index'}</td></tr><tr><td>{_L % 'News of the week'}</td></tr></table>", 0),
    ("old", f"<p>{_Q}</p><p>{_P} {_Q}</p><p>{_Q} {_P}</p><p>{_P}</p>", 1),
    ("old", f"<div>{_L % 'Back'}</div><div>Page 3</div><div>{_L % 'Guest book'}</div>", 0),
    ("text", f"{_P} {_Q}", 1),
    ("line", "A single line of text without any tag", 1),
    # containers named by class only
    ("named", f'<div class="navbar">{_menu("In", "Out")}</div><div class="banner"><p>{_P}</p></div>', 0),
    ("named", f'<div class="post"><h1>Tides</h1><p>Low.</p><p>{_Q}</p><p>High.</p></div>', 1),
    ("named", f'<div class="widget"><p>Tide of the day</p></div><div class="newsletter"><p>{_Q}</p></div>', 0),
    ("named", f'<div id="footer"><p>{_P}</p></div>', 0),
]
