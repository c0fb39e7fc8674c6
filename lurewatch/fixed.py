"""Small, closed lists that decide results.

Everything here is data, not logic.  Each list is stated as plain text in its
natural order, because several rules take the *first* listed entry that
matches.  All of them are bounded (well under 200 lines) and can be replaced
through :class:`lurewatch.dims.Dims`.  Longer tables (public suffixes, the
English word list) are parameters: see ``Dims.from_files``.
"""


def words(text):
    """Split one of the text tables below into a list, order kept."""
    return text.split()


def rows(text):
    """``key: v1 v2`` lines -> ``{key: [v1, v2]}``, order kept."""
    out = {}
    for line in text.strip().splitlines():
        key, _, rest = line.partition(":")
        out[key.strip()] = rest.split()
    return out


# --------------------------------------------------------------------------
# Fixed values for the look-alike rules
# --------------------------------------------------------------------------

# brand: registered domains that really belong to it (rule order = line order)
BRAND_DOMAINS = rows("""
paypal: paypal.com paypal.me paypalobjects.com paypal.co.uk paypal.de paypal.fr paypal.ca paypal.com.au paypal.in
apple: apple.com icloud.com apple.co applecard.apple apple.co.uk apple.de apple.fr apple.ca apple.com.au apple.co.jp apple.in
icloud: apple.com icloud.com
microsoft: microsoft.com live.com msn.com office.com office365.com outlook.com microsoftonline.com azure.com windows.com microsoft.co.uk microsoft.de microsoft.fr microsoft.ca microsoft.com.au microsoft.co.in
outlook: microsoft.com live.com outlook.com
office: microsoft.com office.com office365.com
netflix: netflix.com nflxvideo.net nflximg.net netflix.co.uk netflix.ca netflix.com.au netflix.de netflix.fr
amazon: amazon.com amazon.in amazon.co.uk amazon.de amazon.co.jp amazon.ca amazon.com.au primevideo.com audible.com amazon.es amazon.it amazon.nl amazon.mx amazon.com.br amazon.sg amazon.ae
google: google.com google.co.in google.co.uk youtube.com gmail.com withgoogle.com goo.gl android.com chrome.com google.de google.fr google.co.jp google.com.au google.ca google.es google.it google.nl
gmail: google.com gmail.com
youtube: youtube.com youtu.be google.com
facebook: facebook.com fb.com fbcdn.net meta.com messenger.com
instagram: instagram.com cdninstagram.com facebook.com
whatsapp: whatsapp.com wa.me facebook.com
linkedin: linkedin.com licdn.com lnkd.in linkedin.cn
twitter: twitter.com x.com t.co twimg.com
roblox: roblox.com rbxcdn.com
steam: steampowered.com steamcommunity.com valvesoftware.com
discord: discord.com discordapp.com discord.gg
spotify: spotify.com scdn.co spotifycdn.com spotify.co.uk
twitch: twitch.tv ttvnw.net
ledger: ledger.com ledgerwallet.com
trezor: trezor.io
metamask: metamask.io
coinbase: coinbase.com cbhq.net
binance: binance.com binance.us
uniswap: uniswap.org
kraken: kraken.com
dhl: dhl.com dhl.de dpdhl.com dhl.co.uk dhl.fr dhl.es dhl.it dhl.nl dhl.com.au dhl.co.in
fedex: fedex.com fedex.co.uk fedex.ca fedex.com.au fedex.de fedex.fr
ups: ups.com ups.co.uk ups.ca ups.de ups.fr ups.com.au
usps: usps.com usps.gov
dropbox: dropbox.com dropboxusercontent.com dropbox.co.uk
docusign: docusign.com docusign.net
zoom: zoom.us zoom.com
adobe: adobe.com adobelogin.com adobe.co.uk adobe.de adobe.in
chase: chase.com jpmorganchase.com
wellsfargo: wellsfargo.com
bankofamerica: bankofamerica.com bofa.com
citibank: citibank.com citi.com
hsbc: hsbc.com hsbc.co.uk hsbc.co.in hsbc.com.hk hsbc.ca hsbc.com.au hsbc.com.sg hsbc.ae
barclays: barclays.co.uk barclays.com
hdfcbank: hdfcbank.com
icici: icicibank.com
sbi: onlinesbi.sbi sbi.co.in statebank
axis: axisbank.com
paytm: paytm.com paytm.in
phonepe: phonepe.com
flipkart: flipkart.com
wetransfer: wetransfer.com
figma: figma.com
notion: notion.so notion.com
slack: slack.com
github: github.com githubusercontent.com
gitlab: gitlab.com
""")

# domain -> why it is trusted although it contains a brand word
KNOWN_LEGITIMATE = {
    "applesupport.org": "independent Apple user-support community",
    "applefcu.org": "Apple Federal Credit Union -- unrelated to Apple Inc.",
    "apple-scruffs.com": "Beatles fan site",
    "steamdb.info": "well-known community Steam database",
    "steamcommunity.com": "official Valve community domain",
    "steamdb.io": "SteamDB alternate domain",
    "metabase.com": "analytics company, near-collision with 'metamask'",
    "metafilter.com": "community weblog, near-collision with 'meta'",
    "metacritic.com": "review aggregator, near-collision with 'meta'",
    "googleapis.com": "Google API service domain",
    "googleusercontent.com": "Google user-content domain",
    "gstatic.com": "Google static assets",
    "paypalobjects.com": "PayPal asset CDN",
    "visastudyguide.com": "unrelated to Visa Inc.",
}

# shared hosting platforms known to the look-alike rules
RULE_PLATFORMS = words("""
amazonaws.com googleusercontent.com sharepoint.com azurewebsites.net web.app
firebaseapp.com pages.dev blogspot.com vercel.app netlify.app github.io
gitlab.io herokuapp.com godaddysites.com weeblysite.com weebly.com
wixsite.com typedream.app edgeone.dev replit.app repl.co wasmer.app
lovable.app surge.sh glitch.me onrender.com r2.dev workers.dev duckdns.org
000webhostapp.com webflow.io gitbook.io notion.site carrd.co framer.website
ngrok.io ngrok-free.app trycloudflare.com
""")

# platforms where an organisation page equals the brand name
CODE_HOSTS = words("github.io gitlab.io")

RULE_TLDS = words("""
tk ml ga cf gq cfd top xyz icu buzz monster click link rest surf bar beauty
quest sbs cyou lol work date loan men stream download zip mov info online
site live shop
""")

# look-alike character -> latin letter, position by position
RULE_CONFUSABLES = (
    "аеорсухіѕԁɡνορταεικμｅ1035479$@|!",
    "aeopcyxisdgvoptaeikmeloesatgsali",
)

CORROBORATING_WORDS = words("""
account accounts login logon signin verify verification secure security
update confirm auth authenticate password recover recovery unlock validate
support help service services customer client portal track tracking delivery
parcel package shipment billing payment invoice refund claim reward alert
notice notification suspend suspended restore
""")

# brands shorter than this match on whole words only
SHORT_BRAND_LEN = 4

# --------------------------------------------------------------------------
# Fixed values for the URL feature tables
# --------------------------------------------------------------------------

FEATURE_PLATFORMS = words("""
pages.dev blogspot.com vercel.app netlify.app godaddysites.com weeblysite.com
typedream.app edgeone.dev replit.app wasmer.app lovable.app github.io
gitlab.io web.app firebaseapp.com herokuapp.com azurewebsites.net
onrender.com surge.sh glitch.me repl.co workers.dev wixsite.com
squarespace.com webflow.io framer.website notion.site carrd.co bubbleapps.io
softr.app sharepoint.com amazonaws.com cloudfront.net wordpress.com
tumblr.com medium.com 000webhostapp.com infinityfreeapp.com epizy.com
duckdns.org ngrok.io ngrok-free.app trycloudflare.com
""")

FEATURE_BRANDS = words("""
paypal apple icloud appleid microsoft office365 outlook netflix amazon prime
google gmail facebook instagram whatsapp meta linkedin roblox steam discord
twitch spotify ledger trezor metamask coinbase binance uniswap chase
wellsfargo bankofamerica citibank hsbc barclays dhl fedex ups usps royalmail
disney hulu adobe dropbox docusign wetransfer zoom teams onedrive sharepoint
sbi hdfc icici axis paytm phonepe
""")

FEATURE_BRAND_DOMAINS = rows("""
paypal: paypal.com
apple: apple.com icloud.com
icloud: apple.com icloud.com
appleid: apple.com
microsoft: microsoft.com live.com msn.com office.com
office365: microsoft.com office.com
outlook: microsoft.com live.com outlook.com
netflix: netflix.com
amazon: amazon.com amazon.in amazon.co.uk aws.amazon.com
google: google.com google.co.in withgoogle.com
gmail: google.com gmail.com
facebook: facebook.com fb.com
instagram: instagram.com
whatsapp: whatsapp.com
linkedin: linkedin.com
roblox: roblox.com
steam: steampowered.com steamcommunity.com
discord: discord.com discordapp.com
spotify: spotify.com
ledger: ledger.com
trezor: trezor.io
metamask: metamask.io
coinbase: coinbase.com
binance: binance.com
uniswap: uniswap.org
dhl: dhl.com dhl.de
fedex: fedex.com
ups: ups.com
usps: usps.com
dropbox: dropbox.com
docusign: docusign.com docusign.net
zoom: zoom.us
""")

ACTION_TOKENS = words("""
login signin sign-in verify verification account secure security update
confirm auth authenticate password passwd recover recovery unlock validate
billing payment invoice wallet seed restore
""")

FEATURE_TLDS = words("""
tk ml ga cf gq cfd top xyz icu buzz monster click link rest surf bar beauty
quest sbs cyou lol work date loan men stream download
""")

# digit or sign -> letter used by the feature table
LEET = ("1035478$@!|", "loesatbsail")

# technical words that occur in genuine sub-domains; the long English list is
# a parameter (Dims.from_files(words=...))
TECH_WORDS = words("""
api cdn dev docs git github gitlab lab npm pypi repo sdk staging prod preview
react vue angular svelte next nuxt node deno rust python java kotlin swift
django flask rails laravel spring aws azure gcp cloud docker kube helm
frontend backend fullstack ui ux css html js ts json yaml graphql rest grpc
auth oauth sso jwt saas paas iaas devops ci cd observability grafana
prometheus kafka redis postgres mysql mongo elastic sentry
""")

FEATURES_V2 = words("""
length_url qty_slash_url qty_dot_url qty_hyphen_url qty_digit_url qty_at_url
qty_question_url qty_equal_url qty_percent_url qty_underscore_url
domain_length qty_dot_domain qty_hyphen_domain qty_digit_domain
directory_length qty_slash_directory file_length qty_params
is_hosting_platform subdomain_length subdomain_label_count subdomain_entropy
subdomain_digit_ratio subdomain_hyphen_count subdomain_max_consonant_run
subdomain_vowel_ratio subdomain_is_wordlike subdomain_nonword_ratio
subdomain_has_no_words platform_and_random_subdomain brand_token_present
brand_impersonation action_token_in_path suspicious_tld is_https has_ip_host
qty_subdomain_digits_runs
""")

FEATURES_V1 = words("""
qty_slash_url length_url qty_dot_domain domain_length qty_dot_directory
qty_slash_directory qty_equal_directory qty_at_directory qty_and_directory
qty_percent_directory directory_length qty_hyphen_file qty_plus_file
qty_dollar_file file_length time_response asn_ip time_domain_activation
time_domain_expiration ttl_hostname
""")

NETWORK_FEATURES = FEATURES_V1[15:]

# Multi-part public suffixes.  Everything else uses the last label.  A full
# public-suffix file can be given instead (Dims.from_files(suffixes=...)).
MULTI_SUFFIXES = words("""
co.uk org.uk ac.uk gov.uk ltd.uk plc.uk me.uk net.uk sch.uk nhs.uk police.uk
com.au net.au org.au edu.au gov.au id.au asn.au co.nz net.nz org.nz govt.nz
ac.nz co.jp or.jp ne.jp ac.jp go.jp ad.jp ed.jp gr.jp lg.jp co.kr or.kr
ac.kr go.kr ne.kr re.kr com.cn net.cn org.cn gov.cn edu.cn ac.cn com.hk
net.hk org.hk edu.hk gov.hk idv.hk com.tw org.tw net.tw edu.tw gov.tw idv.tw
com.sg net.sg org.sg edu.sg gov.sg per.sg com.my net.my org.my gov.my edu.my
co.in net.in org.in gen.in firm.in ind.in ac.in edu.in gov.in nic.in res.in
com.br net.br org.br gov.br edu.br blog.br com.mx net.mx org.mx gob.mx
edu.mx com.ar net.ar org.ar gob.ar edu.ar com.co net.co org.co gov.co edu.co
nom.co com.pe org.pe gob.pe edu.pe com.ve com.ec com.uy com.py com.bo com.tr
net.tr org.tr gov.tr edu.tr bel.tr co.za org.za net.za ac.za gov.za web.za
co.il org.il net.il ac.il gov.il muni.il com.ua net.ua org.ua gov.ua edu.ua
com.pl net.pl org.pl edu.pl gov.pl com.am net.am org.am co.th or.th ac.th
go.th in.th co.id or.id ac.id go.id web.id com.ph net.ph org.ph gov.ph
edu.ph com.vn net.vn org.vn edu.vn gov.vn com.pk com.bd com.np com.eg com.ng
co.ke co.tz co.ug com.gh com.sa com.qa com.kw com.om com.bh com.lb com.cy
com.mt com.gr com.ro co.at or.at gv.at ac.at com.es org.es nom.es gob.es
com.pt com.fr asso.fr gouv.fr
""")

# --------------------------------------------------------------------------
# Fixed values for host names
# --------------------------------------------------------------------------

# non-latin character -> latin look-alike, position by position
HOMOGRAPH_CONFUSABLES = (
    "аеорсухѕіјԁոмткӏһѵԝӡқνκρτυοαιβηεϲѡԛ",
    "aeopcyxsijdnmtklhvw3kvkptuoaibnecwq",
)

SHORTENERS = words("""
bit.ly tinyurl.com t.co goo.gl ow.ly is.gd buff.ly rebrand.ly cutt.ly
shorturl.at t.ly rb.gy bit.do soo.gd clck.ru v.gd tiny.cc lnkd.in db.tt
qr.ae adf.ly bitly.com shorte.st tr.im snip.ly shor.by
""")

DISPOSABLE_MAIL_DOMAINS = words("""
mailinator.com guerrillamail.com tempmail.com 10minutemail.com
throwawaymail.com yopmail.com trashmail.com getnada.com temp-mail.org
fakeinbox.com sharklasers.com maildrop.cc
""")

# suffixes tried when regional variants of a trusted domain are proposed
CCTLD_SUFFIXES = words("""
co.uk de fr es it nl co.jp com.au ca co.in in com.br mx com.sg com.hk ie se
ch at be pl com.tr ae sa co.za
""")

# --------------------------------------------------------------------------
# Fixed values for typosquat expansion
# --------------------------------------------------------------------------

SQUAT_BRANDS = rows("""
paypal: paypal.com
apple: apple.com
microsoft: microsoft.com
netflix: netflix.com
amazon: amazon.com
google: google.com
facebook: facebook.com
instagram: instagram.com
linkedin: linkedin.com
roblox: roblox.com
steam: steampowered.com
spotify: spotify.com
ledger: ledger.com
coinbase: coinbase.com
binance: binance.com
dhl: dhl.com
fedex: fedex.com
dropbox: dropbox.com
chase: chase.com
hdfcbank: hdfcbank.com
""")

SQUAT_LEET = ("loesaig", "1035419")
SQUAT_AFFIXES = words("secure login verify support account help")
SQUAT_TLDS = words("net org co info online site top xyz cfd icu click live shop")
SQUAT_HOSTS = words("secure-portal.com account-services.net verify-center.org login-gateway.info")
SQUAT_COUNTRY = words("com.am com.co com.de co.in")
SQUAT_PATHS = words("/login /signin /account/verify /secure/update /auth/confirm / /verify-account /billing/update")

# --------------------------------------------------------------------------
# Fixed values for the mail data set
# --------------------------------------------------------------------------

CATEGORY_CAPS = {"security_transactional": 400, "ordinary_legit": 250, "promo": 60}

SECURITY_SENDER_HINTS = [
    "accounts.google", "no-reply@google", "security", "no-reply@accounts",
    "amazonaws", "awsapps", "aws", "amazon.com", "amazon.in", "github",
    "microsoft", "accountprotection", "linkedin", "paypal", "stripe", "okta",
    "auth", "pearson", "ieee", "msr-cmt", "cmt3", "edas", "noreply",
    "no-reply", "donotreply", "notification", "billing", "invoice", "bank",
    "hdfc", "icici", "sbi", "netflix", "anthropic",
]

SECURITY_SUBJECT_HINTS = [
    "sign-in", "sign in", "signin", "verify", "verification",
    "security alert", "new device", "password", "reset", "two-factor", "2fa",
    "otp", "code", "confirm", "account", "suspicious", "unusual", "login",
    "log in", "invoice", "receipt", "statement", "payment", "order",
    "shipped", "delivery", "expire", "expiring", "action required",
    "authorize", "authentication", "passkey", "recovery", "deactivat",
    "suspend", "support case", "case ", "correspondence",
]

PROMO_HINTS = [
    "newsletter", "marketing", "promo", "% off", "deal", "sale", "webinar",
    "digest", "weekly update", "subscribe", "campaign", "off everything",
    "last chance", "discount",
]

# characters that never show: zero-width, soft hyphen, fillers
INVISIBLE_CHARS = (
    "​‌‍‎‏﻿⁠­͏⁡⁢⁣"
    "⁤ᅟᅠㅤﾠ"
)

# brand: mail categories it plausibly sends
BRAND_PROFILES = {
    "Amazon": words("txn phish_overt phish_subtle marketing"),
    "Flipkart": words("txn phish_overt marketing"),
    "DHL": words("txn phish_overt phish_subtle"),
    "FedEx": words("txn phish_overt phish_subtle"),
    "PayPal": words("txn sec phish_overt phish_subtle"),
    "HDFC Bank": words("txn sec phish_overt"),
    "ICICI Bank": words("txn sec phish_overt"),
    "Coinbase": words("sec phish_overt phish_subtle"),
    "Ledger": words("sec phish_overt phish_subtle"),
    "Netflix": words("txn sec phish_overt marketing"),
    "Spotify": words("txn sec marketing"),
    "Steam": words("sec phish_overt"),
    "Microsoft": words("sec phish_overt phish_subtle marketing"),
    "Google": words("sec phish_overt phish_subtle marketing"),
    "Apple": words("txn sec phish_overt marketing"),
    "Dropbox": words("sec phish_subtle marketing"),
    "Zoom": words("sec phish_subtle marketing"),
    "Adobe": words("txn sec marketing"),
    "LinkedIn": words("sec phish_subtle marketing"),
    "Instagram": words("sec phish_overt"),
}

# --------------------------------------------------------------------------
# Fixed values for request monitoring
# --------------------------------------------------------------------------

# upper bounds (seconds) of the usual HTTP latency histogram; +Inf is implied
LATENCY_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0,
                   2.5, 5.0, 7.5, 10.0]
