"""A sound product page; each keyword breaks one thing."""

import copy
import json

URL = "https://shop.example/product/borealis-desk-lamp-40"

NODE = {
    "@type": "Product",
    "name": "Borealis Desk Lamp 40 with Dimmer",
    "image": ["https://img.example/a.jpg", "https://img.example/b.jpg", "https://img.example/c.jpg"],
    "sku": "BL-0001",
    "brand": {"@type": "Brand", "name": "Borealis"},
    "gtin13": "4006381333931",
    "description": "lamp " * 80,
    "offers": {
        "@type": "Offer",
        "priceCurrency": "GBP",
        "price": "59.90",
        "priceValidUntil": "2099-06-30",
        "availability": "https://schema.org/InStock",
        "itemCondition": "https://schema.org/NewCondition",
    },
}
SPECS = [("Brand", "Borealis"), ("Height", "40 cm"), ("Light", "800 lm"), ("Plug Type", "UK 3-pin plug"), ("In the box", "Lamp, manual"), ("Colour", "Slate")]


def node(**changes):
    out = copy.deepcopy(NODE)
    for key, value in changes.items():
        if value is ...:
            out.pop(key, None)
        else:
            out[key] = value
    return out


def with_offer(**changes):
    return node(offers={**NODE["offers"], **changes})


def page(
    ld=NODE, price="£59.90", chip="Brand New", notes=None, description="d" * 400, specs=SPECS, meta="Borealis lamp with free delivery.",
    canonical=URL, robots=None, headings=1, thumbs=3, blank_alts=0, sold_out=False, tabs=(), title="Borealis Desk Lamp 40 | Shop", extra_head="",
):
    block = "" if ld is None else f'<script type="application/ld+json">{json.dumps(ld)}</script>'
    head = [f"<title>{title}</title>", block, extra_head]
    head += [f'<meta name="description" content="{meta}">'] if meta is not None else []
    head += [f'<link rel="canonical" href="{canonical}">'] if canonical is not None else []
    head += [f'<meta name="robots" content="{robots}">'] if robots else []
    buttons = "".join(f'<button role="radio" aria-checked="{str(on).lower()}" data-testid="condition-tab-{i}">{text}</button>' for i, text, on in tabs)
    hook = "" if sold_out else ' data-testid="condition-price"'
    body = [
        '<nav data-testid="breadcrumb-trail"><a>Home</a><a>Light</a><a>Lamps</a><span>Borealis Desk Lamp 40</span></nav>',
        '<div data-testid="image-gallery"><img src="/1.jpg" alt="front">' + '<img src="/x.jpg" alt=" ">' * blank_alts + '<button data-testid="image-gallery-thumb"></button>' * thumbs + "</div>",
        "<h1>Borealis Desk Lamp 40 with Dimmer</h1>" * headings,
        f'<div data-testid="pdp-price-block"><span{hook}>{price}</span><s class="line-through grey">£79.00</s></div>' if price else "",
        '<form data-testid="back-in-stock-form"></form>' if sold_out else "",
        f"<div>{buttons}</div>",
        f'<span data-testid="sticky-atc-condition-chip">{chip}</span>' if chip else "",
        f'<p data-testid="condition-details-notes">{notes}</p>' if notes else "",
        '<p data-testid="pdp-category-trail">Category: Light &gt; Lamps</p>',
        f'<div data-testid="pdp-description">{description}</div>',
        '<dl data-testid="pdp-specs">' + "".join(f"<div><dt>{k}</dt><dd>{v}</dd></div>" for k, v in specs) + "</dl>",
        "<section><p>Mine arrived with a European plug.</p></section>",
    ]
    return "<!doctype html><html><head>" + "".join(head) + "</head><body>" + "".join(body) + "</body></html>"
