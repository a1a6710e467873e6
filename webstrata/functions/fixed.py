"""Lists and patterns that the rules need as they are."""

# fmt: off
# fixed values, in their own order
ACCOUNT_HOSTS = r"""(?i)^(?:accounts\.google\.com|myaccount\.google\.com|appleid\.apple\.com|account\.apple\.com|secure\d*\.store\.apple\.com|login\.microsoftonline\.com|login\.live\.com|auth0\.com|[a-z0-9-]+\.auth0\.com)$"""
ACCOUNT_SEGMENT = r"""(?i)(?:^|/)(?:log-?in|log-?out|sign-?in|sign-?up|sign-?out|register|account|accounts|my-?page|mypage|member|members|cart|checkout|checkouts|basket|password|reset-password|auth|authentication|oauth2?|sso|wishlist|favorites?)(?:/|$|\.)"""
NOISE_HOST = r"""(?i)(?:^|\.)(?:doubleclick\.net|googlesyndication\.com|googleadservices\.com|googletagmanager\.com|google-analytics\.com|connect\.facebook\.net|analytics\.tiktok\.com|ads-twitter\.com|ads-api\.twitter\.com|analytics\.twitter\.com|criteo\.(?:com|net)|taboola\.com|outbrain\.com|adnxs\.com|amazon-adsystem\.com|scorecardresearch\.com|quantserve\.com|adsrvr\.org|rubiconproject\.com|pubmatic\.com|casalemedia\.com|moatads\.com|yieldmo\.com|appier\.net|ladsp\.com|microad\.jp|i-mobile\.co\.jp|logly\.co\.jp|popin\.cc|karte\.io|treasuredata\.com|newrelic\.com|fullstory\.com|mouseflow\.com|heapanalytics\.com|amplitude\.com|branch\.io|appsflyer\.com|adjust\.com)$"""
NOISE_HOST_PATH = r"""(?i)^(?:(?:[a-z0-9-]+\.)*facebook\.com/tr/?|play\.google\.com/log)$"""
NOISE_PATH = r"""(?i)(?:/api/stats/(?:watchtime|playback|qoe|atr|delayplay|ads)|/youtubei/v1/log_event|/generate_204|/csi_204|/ptracking|/pagead/|/i/api/1\.1/jot/|/1\.1/jot/|/\.well-known/shopify/monorail|/api/collect)"""
TELEMETRY_HOST = r"""(?i)(?:^|\.)(?:google-analytics\.com|analytics\.google\.com|stats\.g\.doubleclick\.net|monorail-edge\.shopifysvc\.com|otlp-http-[a-z0-9-]+\.shopifysvc\.com|error-analytics-[a-z0-9-]+\.shopifysvc\.com|incoming\.telemetry\.mozilla\.org|cloudflareinsights\.com|bat\.bing\.com|clarity\.ms|hotjar\.com|segment\.io|mixpanel\.com|ingest\.sentry\.io|browser-intake-datadoghq\.com|nr-data\.net)$"""
FILE_EXTENSION = r"""(?i)\.(?:pdf|zip|rar|7z|gz|tgz|tar|bz2|xz|dmg|exe|msi|apk|iso|docx?|xlsx?|pptx?|odt|ods|odp|rtf|csv|tsv|epub|mobi|mp3|m4a|aac|wav|flac|ogg|oga|opus|mp4|m4v|mov|webm|mkv|avi|wmv|jpe?g|png|gif|webp|avif|bmp|tiff?|ico|psd|ai|eps|ttf|otf|woff2?)$"""
VOLATILE_KEY = r"""(?i)^(?:_|t|ts|_t|_ts|v|ver|version|cb|cachebust(?:er)?|bust|rand(?:om)?|r|nocache|timestamp|time|nonce|hash|rev|build|seed|_dc)$"""
TRACKING_KEYS = r"""(?i)^(?:utm_.+|fbclid|gclid|dclid|msclkid|yclid|mc_cid|mc_eid|_ga|_gl|ref|referrer|source)$"""
CHALLENGE_TITLE = r"""(?i)(?:just a moment|attention required|access denied|request blocked|robot check|verify (?:that )?you are human|checking your browser|security check|captcha)"""
CHALLENGE_BODY = r"""(?i)(?:cf-chl-|challenge-platform|captcha-container|verify (?:that )?you are human|checking (?:your )?browser|unusual traffic|アクセスが拒否されました|ロボットではないことを確認)"""
LOGIN_TITLE = r"""(?i)(?:^|\b)(?:sign[ -]?in|log[ -]?in|login|authentication|required account)(?:\b|$)|アカウント.{0,8}(?:ログイン|サインイン)|ログイン(?:が必要|してください)?"""
LOGIN_PATH = r"""(?i)(?:^|/)(?:login|log-in|signin|sign-in|auth|authentication|customer-authentication|customer_authentication|authorize|oauth|sso)(?:/|$)"""
ERROR_TITLE = r"""(?i)^\s*(?:(?:http\s*)?[45]\d\d\s*[-:|–—]?\s*)?(?:error(?: page)?|(?:page )?not found|service unavailable|temporarily unavailable|forbidden|bad gateway|gateway timeout|ページが見つかりません|エラーが発生(?:しました)?|利用できません)(?:\s*[-:|–—]\s*.+)?\s*$|^\s*(?:http\s*)?[45]\d\d\s*$"""
TEXT_TYPE = r"""(?i)^(?:text/|application/(?:javascript|ecmascript|json|ld\+json|xml|xhtml\+xml|rss\+xml|atom\+xml|manifest\+json)|image/svg\+xml)"""
IDENTITY_LEAF = r"""(?i)(?:^|\.)(?:id|ids|videoId|playlistId|browseId|channelId|continuation|cursor|query|q|handle|slug|operationName|screen_name|screenName|userId|user_id|productId|handleId)(?:\.\d+)?$"""
OUT_OF_SCOPE = r"""取得深度上限|転送先が保存範囲外|保存対象外|自動で除外|除外パターン|robots\.txt|外部サイトのため保存しません|ログイン誘導先は保存済み|転送先は保存済み"""
BROWSER_START = r"""ブラウザ（[^）]*）を起動できませんでした|ブラウザがキャプチャ開始前に終了|ブラウザのキャプチャ接続がタイムアウト"""
NOT_A_FAILURE = r"""保存済みです|対象外|除外|robots\.txt|深度上限|範囲外|ログイン・カート|外部サイトのため|把握済み|自動で除外"""
LOGIN_REDIRECT = r"""^ログイン誘導先は保存済みです: """
SAVED_REDIRECT = r"""^(?:ログイン誘導先は保存済みです|転送先は保存済みです): (\S+)$"""
AUTH_PATH = r"(?:^|/)(?:login|log-in|signin|sign-in|auth|authentication|customer-authentication|customer_authentication|authorize|oauth|sso)(?:/|$)"
TELEMETRY_PATH = r"(?i)(?:^|/)(?:g/collect|j/collect|collect|b/ss|v1/produce|v1/(?:logs|metrics|traces)|cdn-cgi/rum|beacon|telemetry|analytics)(?:/|$)"
CAPTURE_FAILURE = r"(?i)(?:取得できません|読み込みに失敗|空でした|タイムアウト|ERR_|上限を超え)"
VOLATILE_NAMES = ["buyer_flags", "analytics_trace_id", "code_challenge", "nonce"]
GENERIC_KEYWORDS = ["www", "com", "net", "org", "info", "biz", "app", "dev", "shop", "store", "cdn"]
IPV4_RANGES = [("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4)]
SIGNED_TOKEN = r"^eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}$"
VOLATILE_VALUE = r"^\d{8,}$|^(?i:[a-f0-9]{16,})$|^0?\.\d{6,}$|^(?i:[a-f0-9]{8}(?:-[a-f0-9]{4}){3}-[a-f0-9]{12})$"
CLIP_PATH = r"^/(?:vi|vi_webp|an_webp)/([A-Za-z0-9_-]{6,20})/[A-Za-z0-9_]+\.(?:jpg|jpeg|webp)$"
CLIP_HOST = r"^i\d?\.ytimg\.com$"
#: in every URL whose host is one of these two
IMAGE_HOSTS = r"(?i)(?:ytimg|googleusercontent|ggpht)\.com"
SIZED_HOST = r"(?:^|\.)(?:googleusercontent\.com|ggpht\.com)$"
IMAGE_SIZES = ["maxresdefault", "maxres2", "sddefault", "hq720", "hqdefault", "mqdefault", "default"]
SHOP_BOUNDARY = r"(?i)^/(?:accounts/pre_auth|checkouts|pay|__manifest)(?:/|$)"
SIGN_IN_BOUNDARY = r"(?i)^/gsi/"
VIEWER_HOST = r"^api\.(?:x|twitter)\.com$"
VIEWER_PATH = r"(?i)^/1\.1/(?:flow|graphql)/viewer"
LOGIN_WITH_SHOP = r"(?i)^/services/login_with_shop/"
DISPLAY_FILE = r"(?i)\.(?:m?js|css|png|jpe?g|gif|webp|svg|woff2?)$"
PIXEL_PATH = r"(?i)/cdn/wpm/|^/web-pixels@"
PIXEL_WORKER = r"(?i)/web-pixels@[^/]+/.*/sandbox/worker(?:\.[^/]+)?\.js$"
LOGIN_ISSUE_PATH = r"(?i)/(?:login|signin|authorize|oauth)(?:[_/-]|$)"
NOT_FOUND_REASON = r"HTTP (?:404|410)\b"
REFUSED_REASON = r"(?i)HTTP (?:401|403|429)\b|ERR_HTTP_RESPONSE_CODE_FAILURE|ERR_BLOCKED_BY_RESPONSE|アクセス確認|Bot"
TIMEOUT_REASON = r"(?i)タイムアウト|時間切れ|timed? ?out|超えたため"
NETWORK_REASON = r"(?i)fetch failed|net::ERR_|ECONN|EAI_AGAIN|ENOTFOUND|socket|接続できません|応答しません"
UNAVAILABLE_REASON = r"取得できません|空でした|読み込みに失敗"
PAGE_FAILURE = r"^ページを開けませんでした|ページの保存|保存を完了|HTTP \d{3}"
RESOURCE_REASON = r"素材|参照|本文"
RETRYABLE_CODES = ["BROWSER_UNAVAILABLE", "PAGE_NAVIGATION_FAILED", "PAGE_CAPTURE_TIMEOUT", "PAGE_STALLED", "ETIMEDOUT", "ECONNRESET", "ECONNREFUSED", "EAI_AGAIN", "UND_ERR_SOCKET", "UND_ERR_CONNECT_TIMEOUT", "UND_ERR_HEADERS_TIMEOUT"]
RETRYABLE_MESSAGE = r"(?i)net::ERR_|timed? ?out|タイムアウト|時間切れ|fetch failed|socket hang up|DevTools接続|ECONNRESET|HTTP (?:408|425|429|5\d\d)\b"
MEDIA_TYPE, MEDIA_PATH = r"^(?:video|audio)/|mpegurl|dash\+xml|mp2t", r"\.(?:mp4|m4v|m4s|webm|mov|mkv|mp3|m4a|aac|ogg|oga|opus|wav|flac|ts|m3u8|mpd)$"
IMAGE_TYPE, IMAGE_PATH = r"^image/", r"\.(?:png|jpe?g|gif|webp|avif|svg|ico|bmp)$"
FONT_TYPE, FONT_PATH = r"^font/|woff|opentype|truetype|x-font", r"\.(?:woff2?|ttf|otf|eot)$"
SYSTEM_TYPE, SYSTEM_PATH = r"javascript|ecmascript|text/css|wasm", r"\.(?:m?js|css|wasm)$"
PAGE_TYPE, DATA_TYPE = r"text/html|xhtml", r"json|xml|text/plain|protobuf|graphql|x-www-form"
ADVISORY_MESSAGE = r"(?i)falling back to|deprecated|third-party cookie|\bAbortError:\s*Transition was skipped\b"
ISOLATION_MESSAGE = r"(?i)content security policy|violates the following .* directive|refused to (?:connect|frame|load|execute)|failed to load resource:.*(?:404|405)|mime type .*not executable|second declarative shadow root cannot be created"
ISOLATION_ERROR = r"(?i)ERR_BLOCKED|BLOCKED_BY_RESPONSE|CSP"
BLOCK_END = "title|head|p|div|li|tr|h[1-6]|section|article|header|footer|nav|main|aside|dd|dt|blockquote|pre|table|ul|ol|figure|figcaption|summary|details|option"
PRELOAD_REL, NOT_PRELOADED = r"(?i)\brel\s*=\s*[\"']?[^\"'>]*(?:preload|modulepreload|prefetch)", r"(?i)\bas\s*=\s*[\"']?(?:image|font|fetch|video|audio)"
SHOWN_REL = r"(?i)\brel\s*=\s*[\"']?[^\"'>]*(?:stylesheet|preload|modulepreload|icon)"
SHOWN_RELATION = "(?i)(?:stylesheet|preload|modulepreload|icon)"
IMAGE_ATTRIBUTES = ["data_max_resolution", "data-max-resolution", "data-original", "data-zoom-src", "data-zoom-image", "data-large-image", "data-large_image", "data-full-src"]
PIXEL_SCRIPT, SCRIPT_MIME, WORKER_FILE, SCRIPT_FILE, PAY_SESSION = "(?i)/cdn/wpm/", "(?i)javascript|ecmascript", r"(?i)(?:worker|\.m?js)(?:$|/)", r"(?i)\.m?js$", "(?i)/pay/session(?:/|$)"
COUNTER_IMAGE, FONT_FILES = ("p.typekit.net", "/p.gif"), ("use.typekit.net", "/af/")
ISO_DURATION = r"(?i)^P(?:([\d.]+)D)?(?:T(?:([\d.]+)H)?(?:([\d.]+)M)?(?:([\d.]+)S)?)?$"
SCRIPT_LITERAL = r"""(?i)["'`]((?:https?://|\.{1,2}/|/)[^"'`\s<>()]{1,300}?\.(?:m?js|css)(?:\?[^"'`\s<>()]{0,200})?)["'`]"""
SCRIPT_IMPORT = r"""(?i)\bimport\s*\(\s*["'`]([^"'`\s]{1,300}\.m?js(?:\?[^"'`\s]{0,200})?)["'`]\s*\)"""
INLINE_HANDLER = r"""(?i)(<[a-z][a-z0-9:-]*\b[^<>]*?)\s+on[a-z]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)"""
AUTOPLAY = r"""(?i)(<(?:video|audio)\b[^>]*?)\s+autoplay(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+))?"""
SECRET_NAME = r"(?i)(?:pass(?:word|wd)?|secret|token|cookie|authorization|api[-_]?key|session|credential)"
# public suffixes below countries, wildcards with their exceptions, and private ones: entries of the public list that are met most. The whole list is a parameter of operators.suffixes
COUNTRY_SUFFIXES = {
    "uk": "ac co gov ltd me net nhs org plc police", "jp": "ac ad co ed go gr lg ne or", "au": "asn com edu gov id net org", "nz": "ac co geek govt iwi net org school", "br": "com edu gov net org", "in": "ac co edu gov net org",
    "kr": "ac co go ne or re", "za": "ac co edu gov net org", "cn": "ac com edu gov net org", "tw": "com edu gov net org", "hk": "com edu gov net org", "sg": "com edu gov net org", "my": "com edu gov net org", "id": "ac co go or sch web",
    "th": "ac co go in or", "tr": "com edu gov net org", "mx": "com edu gob net org", "ar": "com edu gob net org", "il": "ac co gov net org", "ua": "com edu gov net org", "pl": "com edu gov net org", "vn": "com edu gov net org",
    "ph": "com edu gov net org", "pk": "com edu gov net org", "eg": "com edu gov net org", "sa": "com edu gov net org", "ae": "ac co gov net org", "ke": "ac co go ne or", "ng": "com edu gov net org", "pe": "com edu gob net org", "co": "com edu gov net org",
}
WILDCARD_COUNTRIES, SUFFIX_EXCEPTIONS = ["bd", "ck", "er", "fk", "jm", "kh", "mm", "np", "pg"], ["www.ck"]
PRIVATE_SUFFIXES = ["github.io", "gitlab.io", "pages.dev", "workers.dev", "web.app", "firebaseapp.com", "vercel.app", "netlify.app", "herokuapp.com", "myshopify.com", "blogspot.com", "azurewebsites.net", "cloudfront.net", "appspot.com", "onrender.com", "fly.dev", "s3.amazonaws.com", "glitch.me", "surge.sh", "readthedocs.io", "translate.goog", "wordpress.com"]
STATUS_TEXT = {"complete": "完了", "complete-with-errors": "一部エラー", "cancelled": "中止", "limit-reached": "上限停止", "failed": "保存失敗", "blocked": "アクセス確認で停止", "login-required": "ログインが必要"}
# fmt: on
