"""They must equal the published behaviour for results to match."""

# Listing links survive a merge at or above this rating.
DEFAULT_MIN_RATING = 4.2

# Labels that the listing page mixes into its category list.
NOISE_CATEGORIES = ["gmb cat.", "gmb cat", "find more", "basic ai teleport review post"]

# Lower-cased page titles that say nothing about the business.
GENERIC_TITLES = ["home", "welcome", "index", "my website", "untitled", "new site", "default title"]

# Script sources or bodies that mean visitors are tracked.
ANALYTICS_PATTERNS = [
    "www.googletagmanager.com/gtm.js",
    "www.google-analytics.com/analytics.js",
    "www.google-analytics.com/gtag/js",
    "connect.facebook.net/en_US/fbevents.js",
    "analytics.js",
    "gtag(",
    "_gaq.push",
]

# Site builders and the page text that gives each one away (compared in lower case).
SITE_BUILDERS = {
    "WordPress": ["/wp-content/", "/wp-includes/"],
    "Wix": ["wix.com", "static.wixstatic.com", "wixsite.com", "wixstatic.com"],
    "Carrd": ["carrd.co", "cdn.carrd.co"],
    "Squarespace": ["squarespace.com", "static.squarespace.com", "squarespace-cdn.com"],
    "Weebly": ["weebly.com", "cdn.weebly.com"],
    "Shopify": ["myshopify.com", "cdn.shopify.com", "Shopify.theme"],
    "Drupal": ["drupalSettings"],
    "BigCommerce": ["cdn.bigcommerce.com", "Bigcommerce"],
    "Webflow": ["webflow.com"],
    "Duda": ["dudamobile.com", "duda.co", "duda.io"],
    "Jimdo": ["jimdo.com", "site.jimdo.com"],
    "SITE123": ["site123.com", "cdn.site123.me"],
    "Zyro": ["zyrosite.com", "zyrocdn.com"],
    "Webnode": ["webnode.com", "webnodecdn.com"],
    "Tilda": ["tilda.cc", "tildacdn.com"],
    "IMCreator": ["imcreator.com", "imcreatorcdn.com"],
    "GoDaddy Website Builder": ["godaddy.com", "godaddysites.com"],
    "Strikingly": ["strikingly.com", "cdn.strikingly.com"],
    "Oxygen": ["oxygen"],
}

# Front-end frameworks in report order: page text, a marking meta name, a marking element
# attribute, a captured browser global, and the framework that hides this one when found.
FRAMEWORKS = [
    {"name": "Next.js", "text": ["__NEXT_DATA__", "_next/"], "meta": "next-head"},
    {"name": "React", "text": ["data-reactroot", "__reactInternalInstance"],
     "global": "__REACT_DEVTOOLS_GLOBAL_HOOK__", "hidden_by": "Next.js"},
    {"name": "Nuxt.js", "text": ["__NUXT__", "_nuxt/"], "meta": "nuxt-head"},
    {"name": "Vue", "text": ["__vue__", "data-v-"], "global": "Vue", "hidden_by": "Nuxt.js"},
    {"name": "Angular", "attribute": "ng-version"},
    {"name": "Svelte", "text": ["data-svelte", "svelte-h"], "global": "__SVELTE_DEVTOOLS_GLOBAL_HOOK__"},
    {"name": "Ember.js", "text": ["ember-view"], "global": "Ember"},
    {"name": "Solid.js", "global": "__SOLID_DEVTOOLS_GLOBAL_HOOK__"},
    {"name": "Alpine.js", "text": ["x-data"], "global": "Alpine"},
    {"name": "Astro", "text": ["_astro/"]},
    {"name": "Marko.js", "text": ["data-marko"], "global": "$Marko"},
    {"name": "Stimulus.js", "text": ["data-controller"]},
    {"name": "Lit / LitElement", "text": ["lit-element"], "global": "LitElement"},
]

# Sitemap paths tried on a domain, best first.
SITEMAP_PATHS = ["sitemap.xml", "sitemap_index.xml", "sitemap-index.xml"]

# One-page builders and heavy frameworks that cost points in the quality score.
PENALIZED_BUILDERS = ["Wix", "Carrd", "Squarespace"]
PENALIZED_FRAMEWORKS = ["Angular", "React", "Vue", "Ember.js", "Backbone", "Dojo"]

# Slug of a search URL that yields no usable text.
FALLBACK_SLUG = "google maps query"

# Addresses that ids are attached to.
KG_SEARCH_URL = "https://www.google.com/search?kgmid="
CID_URL = "https://www.google.com/maps?cid="
PLACE_URL = "https://www.google.com/maps/place/?q=place_id:"
KG_SHORT_URL = "https://g.co/kg"
PHOTO_URL = "https://lh5.googleusercontent.com/p/"
PHOTO_SIZE = "=w1920-h912-k-no"

# Guard in front of JSON answers.
JSON_GUARD = ")]}'"

# Columns every results table must have, in read order.
LISTING_COLUMNS = [
    "listing_link", "position", "name", "categories", "website", "phone", "address",
    "reviews_count", "rating", "status", "source_file", "search_volume",
]

# Column order of a merged table; one flag per input follows.
COMBINED_COLUMNS = [
    "listing_link", "position", "name", "categories", "website", "phone", "address",
    "reviews_count", "rating", "source_file", "search_volume", "map_files", "status",
]

# Header spellings accepted in a query list.
QUERY_URL_HEADERS = ["query_url", "url", "link"]
SEARCH_VOLUME_HEADERS = ["search_volume", "search volume", "volume"]
