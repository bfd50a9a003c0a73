"""Books made in memory for tests."""

import io
import zipfile

CONTAINER = '<?xml version="1.0"?><container xmlns="urn:c"><rootfiles><rootfile full-path="OEBPS/content%2Eopf"/></rootfiles></container>'
OPF = """<?xml version="1.0"?><package xmlns="urn:o" xmlns:dc="urn:d"><metadata><!-- <dc:title>no</dc:title> --><dc:title>A &amp; <![CDATA[B]]>&#33;</dc:title>
<dc:creator/><dc:creator>Me</dc:creator><dc:creator> </dc:creator><dc:creator>You</dc:creator></metadata>
<manifest><item id="c" href="Text/c%20one.xhtml" media-type="application/xhtml+xml"/><item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>
<item id="x" href="extra.xhtml" media-type="application/xhtml+xml"/><item id="i" href="i.png" media-type="image/png"/></manifest><spine><itemref idref="c"/><itemref idref="nope"/></spine></package>"""
PAGE = '<!DOCTYPE html [<!ENTITY x "a>b">]><html xmlns="http://www.w3.org/1999/xhtml"><body><h1 id="h">Title</h1><p class="a">Hello <em class="x">big</em> world<sup>1</sup>.</p><p>12.5</p><ul><li>item</li></ul></body></html>'
EXTRA = "<html><body><p>Notes here.</p></body></html>"
NAV = '<html><body><nav><ol><li><a href="c.xhtml">First <span>one</span></a></li><li><span> </span></li><li><a>Next</a></li></ol></nav></body></html>'
NCX = '<ncx xmlns="urn:n"><navMap><navPoint><navLabel><text> </text></navLabel></navPoint><navPoint><navLabel><text>Only</text></navLabel></navPoint></navMap></ncx>'


def epub(**changes) -> bytes:
    members = {"mimetype": "application/epub+zip", "META-INF/container.xml": CONTAINER, "OEBPS/content.opf": OPF, "OEBPS/Text/c one.xhtml": PAGE, "OEBPS/nav.xhtml": NAV, "OEBPS/extra.xhtml": EXTRA, "OEBPS/i.png": b"\x89PNG"} | changes
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            if data is not None:
                z.writestr(name, data)
    return out.getvalue()
