"""Fixed values that results depend on, in natural order."""

# City names looked for in texts.
CITIES = (
    "تهران", "tehran", "mashhad", "مشهد", "اصفهان", "isfahan", "esfahan", "شیراز", "shiraz", "تبریز", "tabriz", "کرج", "karaj",
    "قم", "qom", "اهواز", "ahvaz", "رشت", "rasht", "کرمان", "kerman", "یزد", "yazd", "ارومیه", "urmia", "همدان", "hamadan",
    "کرمانشاه", "kermanshah", "زاهدان", "zahedan", "اردبیل", "ardabil", "بندرعباس", "bandar abbas", "قزوین", "qazvin",
    "زنجان", "zanjan", "سنندج", "sanandaj", "گرگان", "gorgan", "ساری", "sari", "کیش", "kish",
)
# Words that place a text abroad.
ABROAD = (
    "dubai", "دبی", "uae", "الامارات", "istanbul", "استانبول", "turkey", "ترکیه", "ankara", "آنکارا", "los angeles", "london",
    "toronto", "vancouver", "germany", "berlin", "paris",
)
# Phone numbers once blanks and hyphens are gone, and currency words.
PHONE = "\\+98|0098|0?9[0-9]{9}|021[0-9]{8}"
CURRENCY = "(?iu)تومان|ریال|toman|rial|irt(?![A-Za-z0-9_])"
# Path segments that are no handles, in an address and in a search result.
NO_HANDLE = ("p", "reel", "stories")
BLOCKED_HANDLES = ("p", "reel", "reels", "stories", "explore", "accounts", "share", "legal", "about", "directory", "popular", "instagram")
# Hosts that are no site of a shop.
SOCIAL = ("facebook.com", "twitter.com", "youtube.com", "t.me")
# Search terms of categories; the first pattern that fits decides.
SYNONYMS = (
    ("آرایشی|cosmetics|makeup|beauty", ("لوازم آرایشی", "آرایشی بهداشتی", "cosmetics", "makeup")),
    ("پوشاک|لباس|clothing|fashion", ("پوشاک", "لباس", "بوتیک", "clothing")),
    ("جواهر|طلا|jewelry", ("طلا و جواهر", "جواهرات", "jewelry")),
    ("الکترونیک|موبایل|electronics", ("لوازم الکترونیکی", "موبایل", "electronics")),
    ("غذا|رستوران|food|restaurant", ("رستوران", "غذای آماده", "سفارش غذا")),
    ("مبل|furniture", ("مبلمان", "furniture")),
    ("خودرو|automotive|قطعه", ("لوازم خودرو", "automotive")),
    ("آموزش|education", ("آموزشگاه", "دوره آموزشی")),
    ("پزشک|کلینیک|medical|زیبایی", ("کلینیک", "خدمات پزشکی", "خدمات زیبایی")),
)
# Dialling codes; the first name that the city contains decides.
AREA_CODES = (("تهران", "021"), ("tehran", "021"), ("مشهد", "051"), ("اصفهان", "031"), ("شیراز", "071"), ("تبریز", "041"), ("کرج", "026"))
HOME_COUNTRY = "(?iu)ایران|iran"
# Search query templates for each term; {t} term, {k} country, {c} city. The flag says
# when a line is used: a always, c with a city, h at home, hc at home with a city.
TERM_TEMPLATES = (
    ("a", "{t} {k}"),
    ("c", "{t} {c}"),
    ("h", 'site:instagram.com "{t}" ایران'),
    ("h", 'site:instagram.com "فروش {t}" ایران'),
    ("h", 'site:instagram.com "فروشگاه {t}"'),
    ("h", 'site:instagram.com "خرید {t}" ایران'),
    ("hc", 'site:instagram.com "{t}" {c}'),
    ("hc", 'site:instagram.com "فروشگاه {t}" {c}'),
    ("hc", "فروشگاه {t} {c}"),
    ("hc", "فروش آنلاین {t} {c}"),
    ("hc", "{t} {c} اینستاگرام"),
    ("hc", "فروشگاه اینترنتی {t} {c}"),
    ("hc", '"{t}" "{c}" "تومان"'),
    ("hc", '"{t}" "آدرس" "{c}"'),
    ("h", "فروشگاه اینترنتی {t}"),
    ("h", "خرید آنلاین {t}"),
    ("h", "{t} سفارش از دایرکت"),
    ("h", "{t} برای قیمت دایرکت"),
    ("h", "{t} ارسال به سراسر ایران"),
    ("h", "{t} site:.ir"),
    ("h", '"{t}" سایت رسمی ایران'),
)
# Templates of the category itself, after those of its terms; {p} city or Iran. The
# flag n means abroad, nc abroad with a city.
TAIL_TEMPLATES = (
    *(("h", "{t} " + w + " {p}") for w in ("خرید", "فروش", "سفارش", "قیمت", "ارسال", "فروشگاه", "خرید آنلاین", "سفارش آنلاین", "دایرکت")),
    *(("h", w + " {t} {p}") for w in ("فروشگاه", "فروشگاه اینترنتی", "بوتیک", "برند", "سایت فروش")),
    ("n", 'site:instagram.com "{t}" {k}'),
    ("n", "{t} online shop {k}"),
    ("nc", "{t} store {c}"),
)
# Further queries for a way in which results fell short; {p} city or Iran, {q} city or
# Tehran, {d} dialling code (without one the line is left out).
FURTHER_TEMPLATES = (
    ("influencers", "فروشگاه {t} {c} سفارش واتساپ"),
    ("influencers", "سایت فروش {t} {c}"),
    ("influencers", "{t} فروشگاه اینترنتی {c}"),
    ("influencers", '"{t}" "ثبت سفارش" "{p}"'),
    ("foreign", "{t} آدرس {q}"),
    ("foreign", "{t} تلفن {d}"),
    ("foreign", "{t} سایت .ir"),
    ("foreign", "{t} تومان {c}"),
    ("foreign", '"{t}" "ایران" "آدرس" -dubai -istanbul -turkey -uae'),
    ("generic_instagram", "{t} سایت رسمی {c}"),
    ("generic_instagram", '"{t}" "آدرس" "{p}"'),
    ("generic_instagram", "{t} واتساپ {c} فروشگاه"),
    ("generic_instagram", "{t} site:.ir {c}"),
    ("duplicates", "{t} بوتیک {c}"),
    ("duplicates", "{t} برند ایرانی {c}"),
    ("duplicates", "{t} فروشگاه محلی {c}"),
    ("duplicates", "site:instagram.com {t} {c} فروش آنلاین"),
)
HOME, CAPITAL, MOST_QUERIES, MOST_TERMS = "ایران", "تهران", 48, 5
# Words that show in which way results fell short.
INFLUENCER_WORDS = ("influencer", "اینفلوئنسر", "پیج شخصی", "fan page")
FOREIGN_WORDS = ("dubai", "istanbul", "turkey", "uae", "دبی", "استانبول", "ترکیه")
# Status rank and keys of the lead order.
STATUS_RANK = (("VERIFIED_IRAN", 4), ("NOT_APPLICABLE", 3), ("LIKELY_IRAN", 2), ("UNCERTAIN", 1), ("NOT_IRAN", 0))
SCORE_WEIGHTS = (
    ("business_authenticity", 0.15), ("commercial_intent", 0.15), ("online_shop_strength", 0.15), ("customer_message_potential", 0.15),
    ("shop_bot_fit", 0.15), ("catalog_complexity", 0.1), ("activity_recency", 0.05), ("contactability", 0.05), ("credibility_scale", 0.05),
)
TIERS = ((90, "HOT"), (75, "HIGH"), (60, "MEDIUM"), (40, "LOW"))
LOWEST_TIER = "REJECT"
