"""Word lists and thresholds of the text rules. Fixed values throughout: results depend on each of them."""

BOILERPLATE_PHRASES = (
    "available here", "back to top", "click here", "continue reading", "cookie policy", "go to next", "go to previous", "learn more", "log in",
    "privacy policy", "read more", "related articles", "share this", "sign in", "sign up", "skip to content", "subscribe", "terms of service",
)
MEDICAL_TERMS = (
    "blood", "bodies", "body", "child", "children", "diabetes", "diet", "disease", "doctor", "food", "health", "infection", "medical", "pain",
    "symptoms", "treatment", "viral", "virus",
)
NAVIGATION_TERMS = (
    "accept cookies", "advertisement", "back to top", "click here", "continue reading", "cookie policy", "footer", "go to next", "go to previous",
    "header", "home", "learn more", "log in", "menu", "privacy policy", "read more", "related articles", "search", "share this", "sign in", "sign up",
    "skip to content", "subscribe", "terms of service",
)
GENERIC_FORMULAE = ("in the same time", "the first step", "the most important", "the process")
MALFORMED_FRAGMENTS = ("F-the-s", "Newth", "based-in", "in-in", "to-in")
PRODUCT_TERMS = (
    "affiliate", "amazon", "best price", "buy now", "cart", "checkout", "coupon", "customer reviews", "discount", "free shipping", "lowest price",
    "order now", "price", "product", "products", "rating", "reviews", "sale", "shop", "shopping", "sponsored", "store", "warranty",
)
DICTIONARY_TERMS = (
    "adjective", "antonyms", "definition", "dictionary", "encyclopedia", "etymology", "noun", "plural", "pronunciation", "synonyms", "thesaurus",
    "verb", "word origin",
)
PAGE_TERMS = (
    "all rights reserved", "archived from", "copyright", "edit this page", "follow us", "last modified", "page was last edited", "permalink",
    "printable version", "retrieved from", "submit", "view source",
)
PAGE_INSTRUCTIONS = (
    "add to this article", "audiencestart", "begin typing or use", "click submit", "discover the cosmos", "editing tools above",
    "editors will review what", "imcopy", "invited audience members", "publishing partner program", "remote presentation", "send the link below",
    "simply begin typing", "submitted and determine whether to revise",
)
COMPACT_WIKI = ("editthispagefromfamilysearchwiki", "familysearchwiki", "editthispage")
HTML_ARCHIVE = (
    "the following html text is provided to enhance online readability",
    "provided to enhance online readability",
    "archived web page remains online",
    "this page will not be altered or updated",
    "this article has been archived from the now-defunct",
    "has been archived from the now-defunct",
    "this text is part of: table of contents:",
)
SCIENCE_FAIR = ("science fair project encyclopedia",)
LOOKUP_FRAGMENTS = (
    "one of the mysteries of the english language finally explained",
    "in english, many things are named after a particular country",
    "view your list of saved words",
)
COOKIE_VIDEO = (
    "please activate cookies in your browser",
    "please enable cookies in your browser",
    "cookies are disabled in your browser",
    "by using this site you agree to our use of cookies",
    "rating is available when the video has been rented",
    "sign in to add this video",
    "sign in to report inappropriate content",
    "login to rate",
    "log in to rate",
    "watch queue queue",
    "add to want to watch this again later",
)
PRODUCT_WIDGETS = ("the leading ebooks store online", "huge product rangeover", "140,000 books & equipment products rapid shipping")
TAGLINES = (
    "the latest news from academia, regulators research labs",
    "latest news from academia, regulators research labs and other things of interest",
    "tech moves fast! stay ahead of the curve",
    "learn something new every day",
    "subscribe today to get the latest",
    "delivered right to your inbox",
    "right in your inbox. sign up for our email newsletter",
    "follow us on facebook",
    "follow us on twitter",
    "follow @universetoday",
    "want to stay on top of all the space news? follow",
    "grow your tree by exploring billions of historical records",
    "700 journals and 15,000,000 readers",
    "readership is 10 times more when compared to other subscription journals",
)
SEO_FRAGMENTS = (
    "best essay writing service",
    "essay format generator",
    "essay quizlet",
    "what is 1 pages essay double spaced",
    "how many pages best essay",
    "top research paper topics good or bad",
)
RESIDUAL_WEB = (
    "this preview has intentionally blurred sections",
    "sign up to view the full version",
    "this article is only available in the pdf format",
    "download the pdf to view the article",
    "it looks like you're using an ad blocker",
    "below are the first 10 and last 10 pages of uncorrected machine-read text",
    "search for native plants by scientific name, common name or family",
)
SCAFFOLD_PHRASES = (
    "raw language-model pretraining", "course-planning paragraph", "strong continuation", "continuation target", "the model", "same planning principle",
    "in scenario", "student-facing explanation", "the same answer should switch", "catalog evidence", "should remain anchored",
    "useful catalog continuation",
)
DISCOURSE_MARKERS = ("because", "therefore", "for example", "however", "although", "when ")
CATEGORY_NAMES = ("individual differences", "methods", "statistics", "clinical", "educational", "industrial", "professional items", "world psychology")

BULLET_LINE = r"^\s*(?:[-*•]+|\d+[.)]|[A-Z][.)])\s+"
LABEL_LINE = (
    r"(?i)^\s*(?:about|advertisement|archive|author|breadcrumb|byline|categories?|chapter|comments?|contact|contents?|copyright|date|download|footer|header|home|image|keywords?|menu|"
    r"more|navigation|next|page|posted|previous|privacy|published|read more|related|section|share|source|subscribe|tags?|title|updated)\s*[:|.-]\s*"
)
TOC_LINE = r"\.{3,}\s*\d+\s*$"
SEPARATORS = r"(?:[-_=*#]{4,}|[|]{2,}|/{3,}|>{3,}|<{3,})"
QUESTION_STARTS = r"(?:^|[.!?]\s+)(?:what|how|why|when|where|which|who|can|do|does|is|are)\b"
METADATA_WORDS = r"\b(?:posted|updated|categories?|tags?|related|read more|subscribe|share|comments?)\b"

RETRIEVAL_STOPWORDS = (
    "about after also and are because before below between but can does for from has have hello hey hi how im i'm into is it its of on or that the "
    "their this to what when where which who why with would dr mr mrs ms"
).split()

#: Behaviour buckets of answers: aliases, phrases, and row and token shares with the least number of examples.
BUCKET_ALIASES = {
    "constructive": "constructive_direct", "constructive_direct": "constructive_direct", "direct_answer": "constructive_direct",
    "informative_abstention": "informative_abstention", "abstention": "informative_abstention", "clarifying_question": "clarifying_question",
    "clarifying": "clarifying_question", "comparison_question": "clarifying_question", "hard_refusal": "hard_refusal", "refusal": "hard_refusal",
}
REFUSAL_PHRASES = (
    "i can't help with that", "i cannot help with that", "i won't help with that", "i will not help with that", "i can't comply", "i cannot comply",
)
CLARIFY_PHRASES = ("tell me ", "share ", "which two", "what are your goals", "what kind of work", "what interests you")
ABSTAIN_PHRASES = (
    "could not verify", "couldn't verify", "could not find", "couldn't find", "do not want to guess", "don't want to guess", "avoid guessing",
    "what is missing", "not in the current", "check the current catalog", "check the latest catalog", "ask an advisor",
)
BUCKET_TARGETS = {
    "constructive_direct": (0.68, 0.78, 96),
    "clarifying_question": (0.20, 0.15, 48),
    "informative_abstention": (0.08, 0.05, 16),
    "hard_refusal": (0.04, 0.02, 8),
}

#: Families of phrases that a scan of a finished corpus reports.
HIDDEN_PATTERNS = {
    "medical_body_terms": MEDICAL_TERMS,
    "product_commercial_terms": PRODUCT_TERMS,
    "dictionary_fragment_terms": DICTIONARY_TERMS,
    "edit_this_page": ("edit this page",),
    "follow_us": ("follow us",),
    "copyright": ("copyright",),
    "archived_web_page": ("archived web page", "archived from"),
    "list_menu_navigation_residue": NAVIGATION_TERMS,
    "learn_something_new_every_day": ("learn something new every day",),
    "familysearch_wiki_boilerplate": ("edit this page", "edit this page from familysearch wiki", "familysearch wiki", *COMPACT_WIKI),
    "html_archive_boilerplate": HTML_ARCHIVE,
    "science_fair_encyclopedia": SCIENCE_FAIR,
    "lookup_fragment_boilerplate": LOOKUP_FRAGMENTS,
    "cookie_video_widget_boilerplate": COOKIE_VIDEO,
    "product_widget_boilerplate": PRODUCT_WIDGETS,
    "newsletter_source_tagline": TAGLINES,
    "seo_question_fragment": SEO_FRAGMENTS,
    "residual_web_boilerplate": RESIDUAL_WEB,
    "category_menu_chain": ("individual differences | methods | statistics | clinical", "methods | statistics | clinical | educational"),
    "article_page_boilerplate": (*PAGE_TERMS, *PAGE_INSTRUCTIONS),
    "generated_domain_remnants": (
        "local_mvp_v2_", "webb_catalog_large_lm_corpus", "webb_advising_large_lm_corpus", "webb_domain_large_lm_corpus", "webb_handbook_large_lm_corpus",
        "webb_school_context_large_lm_corpus", *SCAFFOLD_PHRASES,
    ),
}
