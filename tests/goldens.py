"""Fixed expected results: URL cases and host lists (fixed values)."""

# "!" = must be flagged, "." = must stay clean
LOOKALIKE_CASES = """
. https://www.paypal.com/login
. https://paypal.com/signin
. https://open.spotify.com/playlist/37i9dQZF1DXcBWIGoYBM5M
. https://www.hdfcbank.com/personal/borrow/popular-loans
. https://stackoverflow.com/questions/tagged/python
. https://docs.python.org/3/library/json.html
! http://paypa1-secure.com/account/verify
! https://paypalsupport.com/
! https://login-steam.com/
! https://fedexverify.com/
! https://dropbox.site/
! https://linkedin.info/
! https://www.roblox.com.am/users/378768172502/profile
! https://ledger--live-auth.pages.dev/
! https://www.netflixcln.vercel.app/
! https://verify-dhl.com/signin
! https://dhl-secure.secure-portal.com/signin
! https://dhl.account-services.net/secure/update
. https://groups.google.com/g/some-group
. https://www.startups.com/
. https://backups.example.org/
! https://instagram-cmd.github.io/accounts/index.html
. https://microsoft.github.io/monaco-editor/
. https://netflix.github.io/
. https://reactjs.github.io/react-docs/
. https://johnsmith.github.io/portfolio/
. https://pytorch.github.io/
. https://docs.pages.dev/
. https://nextjs-commerce.vercel.app/
. https://myportfolio.pages.dev/
! https://support-dhl.com/account/verify
! https://account-dhl.com/secure/update
! https://ups-tracking-update.com/
. https://google.github.io/styleguide/
. https://apple.github.io/swift-format/
! https://paypal-verify.pages.dev/
! https://a.b.netflix-login.pages.dev/
. https://sub.docs.pages.dev/
! https://dhlaccount.com/signin
! https://dhlsupport.com/signin
! https://dhlhelp.com/account/verify
! https://dhlverify.com/signin
! https://upstracking.com/parcel
. https://upstream.com/
. https://upsell.com/pricing
. https://startups.com/
. https://groups.io/g/some-group
. https://closeups-photography.com/portfolio
. https://google.de/
. https://fedex.co.uk/
. https://apple.co.uk/
. https://paypal.co.uk/signin
. https://hsbc.com.hk/
. https://applefcu.org/
. https://apple-scruffs.com/
. https://steamdb.info/app/570/
. https://metabase.com/
. https://applesupport.org/
! https://apple-verify-account.com/signin
! https://steam-login.info/
. https://amazonaws.com/
! https://steam-login.info/signin
! https://paypal-verify.s3.amazonaws.com/login
! https://netflix-billing.s3.amazonaws.com/
. https://d1234abcd.cloudfront.net/assets/app.js
. https://myapp.s3.amazonaws.com/index.html
"""

KNOWN_GOOD = """
paypal.com www.paypal.com apple.com icloud.com microsoft.com office.com outlook.com live.com netflix.com amazon.com
amazon.in amazon.co.uk google.com gmail.com youtube.com facebook.com instagram.com linkedin.com x.com roblox.com
steampowered.com discord.com spotify.com twitch.tv ledger.com trezor.io metamask.io coinbase.com binance.com
uniswap.org kraken.com dhl.com fedex.com ups.com usps.com dropbox.com docusign.com zoom.us adobe.com chase.com
wellsfargo.com bankofamerica.com citibank.com hsbc.com barclays.co.uk hdfcbank.com icicibank.com axisbank.com
paytm.com phonepe.com flipkart.com wetransfer.com figma.com notion.so slack.com github.com gitlab.com amazon.de
amazon.co.jp amazon.ca amazon.com.au google.co.in google.co.uk google.de google.fr hsbc.co.uk hsbc.co.in hsbc.com.hk
fedex.co.uk dhl.de dhl.co.uk ups.co.uk apple.co.uk microsoft.co.uk netflix.co.uk paypal.co.uk paypal.me startups.com
upstream.com backups.com groups.io applesupport.org applefcu.org apple-scruffs.com metabase.com metafilter.com
metacritic.com steamcommunity.com steamdb.info visa.com mastercard.com stripe.com razorpay.com wikipedia.org
stackoverflow.com reddit.com bbc.co.uk nytimes.com cloudflare.com mozilla.org python.org npmjs.com pypi.org docker.com
kubernetes.io arxiv.org coursera.org edx.org irctc.co.in indiapost.gov.in uidai.gov.in incometax.gov.in docs.pages.dev
pytorch.github.io microsoft.github.io google.github.io reactjs.github.io vitejs.dev
""".split()

ORDINARY = """
https://en.wikipedia.org/wiki/Machine_learning
https://stackoverflow.com/questions/tagged/python
https://news.ycombinator.com/item?id=39485720
https://arxiv.org/abs/1706.03762
https://www.bbc.co.uk/news/technology-68123456
https://docs.python.org/3/library/json.html
https://pypi.org/project/requests/
https://www.reddit.com/r/programming/
https://github.com/pytorch/pytorch/issues/12345
https://www.coursera.org/learn/machine-learning
https://mail.google.com/mail/u/0/#inbox
https://www.irctc.co.in/nget/train-search
https://www.hdfcbank.com/personal/borrow/popular-loans
https://open.spotify.com/playlist/37i9dQZF1DXcBWIGoYBM5M
https://www.amazon.in/gp/bestsellers
https://in.linkedin.com/in/someone-real-12345
""".split()

BRAND_PATHS = ["/", "/login", "/signin", "/account", "/help", "/support", "/security"]

# url, then feature values worked out by hand (words: portfolio react auth live git docs)
FEATURE_CASES = [
    ("https://3rf3x34x.pages.dev/", dict(is_hosting_platform=1, subdomain_is_wordlike=0, platform_and_random_subdomain=1, brand_impersonation=0)),
    ("https://myportfolio.pages.dev/", dict(is_hosting_platform=1, subdomain_is_wordlike=1, platform_and_random_subdomain=0, subdomain_has_no_words=0)),
    ("https://satya-1205.github.io/NetflixWebsite/", dict(is_hosting_platform=1, brand_impersonation=1, brand_token_present=1, directory_length=0, file_length=14)),
    ("https://eshwarkole1641-esh.github.io/spotify-clone/", dict(brand_impersonation=1, qty_subdomain_digits_runs=1)),
    ("https://reactjs.github.io/react-docs/", dict(is_hosting_platform=1, subdomain_has_no_words=0, brand_impersonation=0)),
    ("http://paypa1-secure.com/account/verify", dict(is_https=0, brand_impersonation=1, action_token_in_path=1, directory_length=8, file_length=6)),
    ("https://www.paypal.com/signin", dict(brand_token_present=1, brand_impersonation=0, subdomain_length=0, action_token_in_path=1)),
    ("https://ledger--live-auth.pages.dev/", dict(is_hosting_platform=1, brand_impersonation=1, subdomain_hyphen_count=3)),
    ("https://github.com", dict(length_url=18, is_hosting_platform=0, brand_token_present=0, qty_slash_url=2)),
    ("http://[::1", dict(length_url=0, qty_slash_url=0, is_https=0)),
    ("http://1.2.3.4/x.tk", dict(has_ip_host=1, domain_length=0, suspicious_tld=0)),
    ("", dict(length_url=7, qty_slash_url=2)),
]
