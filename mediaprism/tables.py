"""Word lists, lookup tables, patterns and presets that results depend on.

They stand here together, as plain text and in their natural order; the order of lists matters where a first match wins.
"""

from __future__ import annotations

MEDIA_TYPES = ("image", "video", "audio", "document")

# ---- URLs ----------------------------------------------------------------------------------------------------------
TWO_PART_TLDS = ("co.uk", "com.au", "co.jp", "co.nz", "com.br", "org.uk")
#: First and last address of each private or reserved IPv4 range.
PRIVATE_RANGES = (
    ("10.0.0.0", "10.255.255.255"), ("172.16.0.0", "172.31.255.255"), ("192.168.0.0", "192.168.255.255"), ("127.0.0.0", "127.255.255.255"),
    ("169.254.0.0", "169.254.255.255"), ("0.0.0.0", "0.255.255.255"), ("100.64.0.0", "100.127.255.255"), ("192.0.0.0", "192.0.0.255"),
    ("192.0.2.0", "192.0.2.255"), ("198.51.100.0", "198.51.100.255"), ("203.0.113.0", "203.0.113.255"), ("224.0.0.0", "239.255.255.255"),
    ("240.0.0.0", "255.255.255.255"),
)
EMBEDDED_PARAMS = ("url", "src", "image", "img", "imgurl", "mediaurl", "iai", "orig", "original", "source", "ref", "target")
SHORTENERS = tuple(
    "bit.ly bitly.com t.co goo.gl tinyurl.com ow.ly is.gd buff.ly adf.ly j.mp tr.im cli.gs short.to budurl.com ping.fm post.ly just.as bkite.com "
    "snipr.com fic.kr loopt.us doiop.com short.ie kl.am wp.me rubyurl.com om.ly to.ly bit.do lnkd.in db.tt qr.ae cur.lv ity.im q.gs po.st bc.vc "
    "twitthis.com u.teleportd.com dead.net bzfd.it waa.ai tiny.pl amzn.to youtu.be rb.gy cutt.ly rebrand.ly".split()
)
TRACKING_PARAMS = tuple(
    "utm_source utm_medium utm_campaign utm_term utm_content utm_id utm_source_platform utm_creative_format utm_marketing_tactic fbclid fb_action_ids "
    "fb_action_types fb_source fb_ref gclid gclsrc dclid msclkid twclid igshid mc_eid _hsenc _hsmi mkt_tok oly_enc_id oly_anon_id vero_id wickedid "
    "_ga _gl _ke trk_contact trk_msg trk_module trk_sid ref affiliate_id aff_id partner_id si feature share __s s_kwcid spm algo_pvid algo_expid".split()
)

# ---- files and MIME types ------------------------------------------------------------------------------------------
EXTENSION_MIME = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "jpe": "image/jpeg", "jfif": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp",
    "svg": "image/svg+xml", "bmp": "image/bmp", "ico": "image/x-icon", "avif": "image/avif", "heic": "image/heic", "heif": "image/heif",
    "tiff": "image/tiff", "tif": "image/tiff", "mp4": "video/mp4", "m4v": "video/mp4", "webm": "video/webm", "mkv": "video/x-matroska",
    "avi": "video/x-msvideo", "mov": "video/quicktime", "wmv": "video/x-ms-wmv", "flv": "video/x-flv", "ogv": "video/ogg", "3gp": "video/3gpp",
    "mpg": "video/mpeg", "mpeg": "video/mpeg", "mp3": "audio/mpeg", "wav": "audio/wav", "ogg": "audio/ogg", "oga": "audio/ogg", "flac": "audio/flac",
    "aac": "audio/aac", "m4a": "audio/mp4", "wma": "audio/x-ms-wma", "aiff": "audio/aiff", "opus": "audio/opus", "pdf": "application/pdf",
    "doc": "application/msword", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xls": "application/vnd.ms-excel",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "ppt": "application/vnd.ms-powerpoint",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "txt": "text/plain", "rtf": "application/rtf",
}
MIME_EXTENSION = {
    "image/jpeg": "jpg", "image/png": "png", "image/gif": "gif", "image/webp": "webp", "image/svg+xml": "svg", "image/bmp": "bmp", "image/x-icon": "ico",
    "image/vnd.microsoft.icon": "ico", "image/avif": "avif", "image/heic": "heic", "image/heif": "heif", "image/tiff": "tiff", "video/mp4": "mp4",
    "video/webm": "webm", "video/x-matroska": "mkv", "video/x-msvideo": "avi", "video/quicktime": "mov", "video/x-ms-wmv": "wmv", "video/x-flv": "flv",
    "video/ogg": "ogv", "video/3gpp": "3gp", "video/mpeg": "mpg", "audio/mpeg": "mp3", "audio/wav": "wav", "audio/wave": "wav", "audio/x-wav": "wav",
    "audio/ogg": "ogg", "audio/flac": "flac", "audio/aac": "aac", "audio/mp4": "m4a", "audio/x-ms-wma": "wma", "audio/aiff": "aiff", "audio/opus": "opus",
    "application/pdf": "pdf", "application/msword": "doc", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.ms-excel": "xls", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx", "application/vnd.ms-powerpoint": "ppt",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx", "text/plain": "txt", "application/rtf": "rtf",
}
DATA_URL_EXTENSION = {
    "image/jpeg": "jpg", "image/jpg": "jpg", "image/png": "png", "image/gif": "gif", "image/webp": "webp", "image/svg+xml": "svg", "image/bmp": "bmp",
    "image/ico": "ico", "image/x-icon": "ico", "image/vnd.microsoft.icon": "ico", "image/avif": "avif", "image/heic": "heic", "image/heif": "heif",
    "image/tiff": "tiff", "video/mp4": "mp4", "video/webm": "webm", "video/ogg": "ogv", "audio/mpeg": "mp3", "audio/ogg": "ogg", "audio/wav": "wav",
    "application/pdf": "pdf",
}
#: (signature, MIME type); the first that fits wins, RIFF counts only with WEBP at byte 8 if there are 12 bytes.
MAGIC = (
    ("FFD8FF", "image/jpeg"), ("89504E470D0A1A0A", "image/png"), ("474946383761", "image/gif"), ("474946383961", "image/gif"), ("52494646", "image/webp"),
    ("424D", "image/bmp"), ("00000100", "image/x-icon"), ("00000200", "image/x-icon"), ("000000", "video/mp4"), ("1A45DFA3", "video/webm"),
    ("494433", "audio/mpeg"), ("FFFB", "audio/mpeg"), ("FFFA", "audio/mpeg"), ("4F676753", "audio/ogg"), ("25504446", "application/pdf"),
)
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "webp", "svg", "bmp", "ico", "avif", "heic", "heif", "tiff", "tif", "jfif")
VIDEO_EXTENSIONS = ("mp4", "webm", "mkv", "avi", "mov", "wmv", "flv", "ogv", "m4v", "3gp", "mpg", "mpeg")
AUDIO_EXTENSIONS = ("mp3", "wav", "ogg", "flac", "aac", "m4a", "wma", "aiff", "opus")
DOCUMENT_EXTENSIONS = ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "txt", "rtf")
EXTENSION_ALIASES = {"jpeg": "jpg", "jpe": "jpg", "jfif": "jpg", "tif": "tiff", "htm": "html", "mpeg": "mpg"}
DOCUMENT_MIME_WORDS = ("document", "msword", "excel", "powerpoint", "spreadsheet", "presentation")
RESERVED_NAMES = ("CON", "PRN", "AUX", "NUL", "COM1", "COM2", "COM3", "COM4", "COM5", "COM6", "COM7", "COM8", "COM9", "LPT1", "LPT2", "LPT3", "LPT4", "LPT5", "LPT6", "LPT7", "LPT8", "LPT9")
SAFE_MIME_TYPES = (
    "image/jpeg", "image/png", "image/gif", "image/webp", "image/svg+xml", "image/bmp", "image/tiff", "image/x-icon", "image/avif", "image/heic",
    "image/heif", "video/mp4", "video/webm", "video/ogg", "video/quicktime", "video/x-msvideo", "video/x-matroska", "video/3gpp", "video/3gpp2",
    "audio/mpeg", "audio/wav", "audio/ogg", "audio/webm", "audio/aac", "audio/flac", "audio/midi", "audio/x-midi", "application/pdf",
)

# ---- type detection ------------------------------------------------------------------------------------------------
IMAGE_URL_PATTERNS = (
    r"/image[s]?/", r"/img[s]?/", r"/photo[s]?/", r"/picture[s]?/", r"/media/", r"/upload[s]?/", r"/asset[s]?/", r"/static/", r"\.cloudinary\.com/",
    r"\.imgix\.net/", r"\.unsplash\.com/", r"\.pexels\.com/", r"images\.unsplash\.com/", r"\.twimg\.com/", r"\.fbcdn\.net/", r"\.cdninstagram\.com/",
    r"\.pinimg\.com/", r"\.giphy\.com/", r"\.imgur\.com/", r"i\.imgur\.com/", r"\.gstatic\.com/",
)
IMAGE_FORMAT_PARAMS = ("format", "f", "type", "output", "fm", "ext")
IMAGE_OPERATION_PARAMS = ("w", "h", "width", "height", "size", "resize", "crop", "fit", "q", "quality", "auto", "dpr")
IMAGE_PATH_WORDS = ("/image", "/img", "/photo", "/picture")
UI_PATH_WORDS = ("/icon", "/icons/", "/btn", "/button", "/arrow", "/check", "/close", "/menu", "/nav", "/logo", "/favicon", "/sprite", "/ui/", "/assets/ui", "/images/icons")
STREAMING_EXTENSIONS = ("m3u8", "m3u", "mpd")
#: (host pattern, patterns of path and query; none means that the host is enough)
VIDEO_PLATFORMS = (
    (r"^(www\.)?youtube\.com$", (r"/watch\?", r"/embed/", r"/v/")), (r"^youtu\.be$", ()), (r"^(www\.)?vimeo\.com$", (r"/\d+", r"/video/")),
    (r"^player\.vimeo\.com$", ()), (r"^(www\.)?dailymotion\.com$", (r"/video/", r"/embed/")), (r"^(www\.)?twitch\.tv$", (r"/videos/", r"/clip/")),
    (r"^clips\.twitch\.tv$", ()), (r"^(www\.)?tiktok\.com$", (r"/@[\w.-]+/video/",)), (r"^(www\.)?facebook\.com$", (r"/watch/", r"/videos/")),
    (r"^(www\.)?instagram\.com$", (r"/reel/", r"/tv/")), (r"^(www\.)?twitter\.com$", (r"/status/[^/]+/video/",)), (r"^(www\.)?x\.com$", (r"/status/[^/]+/video/",)),
)
VIDEO_URL_PATTERNS = (
    r"\.cloudfront\.net/[^?#]*\.(mp4|webm|m3u8)", r"\.akamaized\.net/[^?#]*\.(mp4|webm|m3u8)", r"\.fastly\.net/[^?#]*\.(mp4|webm)", r"video\.twimg\.com/",
    r"\.cdninstagram\.com/[^?#]*video", r"\.fbcdn\.net/[^?#]*video",
)
AUDIO_PLATFORMS = (
    (r"^(www\.)?spotify\.com$", (r"/track/", r"/episode/", r"/album/")), (r"^open\.spotify\.com$", ()), (r"^(www\.)?soundcloud\.com$", ()),
    (r"^(www\.)?bandcamp\.com$", ()), (r"^[a-z0-9-]+\.bandcamp\.com$", ()), (r"^(www\.)?mixcloud\.com$", ()), (r"^(www\.)?audiomack\.com$", ()),
    (r"^(www\.)?podcasts\.apple\.com$", ()), (r"^(www\.)?anchor\.fm$", ()),
)
AUDIO_URL_PATTERNS = (r"\.soundcloud\.com/[^?#]*\.(mp3|ogg|wav)", r"^https?://audio[^/]*\.cloudfront\.net/", r"\.audio\.", r"/audio/", r"/podcast[^?#]*\.(mp3|m4a|ogg)")
AUDIO_STREAM_PATTERNS = (r"\.pls$", r"\.asx$", r"/stream/", r"/listen/", r"icecast", r"shoutcast")
DOCUMENT_PLATFORMS = (
    (r"^docs\.google\.com$", (r"/document/", r"/spreadsheets/", r"/presentation/", r"/viewer")), (r"^drive\.google\.com$", (r"/file/", r"/viewer")),
    (r"^[a-z0-9-]+\.sharepoint\.com$", (r"/_layouts/", r"/Documents/")), (r"^(www\.)?dropbox\.com$", (r"(?i)/s/[^?#]*\.(pdf|doc|docx|xls|xlsx|ppt|pptx)",)),
    (r"^(www\.)?scribd\.com$", (r"/document/", r"/doc/")), (r"^(www\.)?slideshare\.net$", ()), (r"^(www\.)?issuu\.com$", ()), (r"^(www\.)?box\.com$", (r"/s/", r"/file/")),
)
DOCUMENT_URL_PATTERNS = (r"/pdf/", r"/documents?/", r"/downloads?/", r"/files?/", r"\.pdf\?", r"attachment[^?#]*\.pdf", r"download[^?#]*\.pdf")
DOCUMENT_PATH_WORDS = ("/pdf", "/doc", "/document", "/download", "/file", "/attachment", "/export")
#: Longer URLs are not matched against these patterns.
MAX_PATTERN_URL = 2048

# ---- filters -------------------------------------------------------------------------------------------------------
EXCLUDE_PATTERNS = {
    "tracking": (r"pixel\.(gif|png)", r"beacon\.(gif|png)", r"spacer\.(gif|png)", r"clear\.(gif|png)", r"1x1\.(gif|png)", r"tracking", r"analytics", r"stat\.(gif|png)"),
    "social_icons": (r"facebook[^/]*icon", r"twitter[^/]*icon", r"instagram[^/]*icon", r"linkedin[^/]*icon", r"pinterest[^/]*icon", r"share[^/]*button", r"social[^/]*icon"),
    "ui_elements": (r"/icons?/", r"/sprites?/", r"/buttons?/", r"/arrows?/", r"/logos?/", r"loading\.(gif|png|svg)", r"spinner\.(gif|png|svg)"),
    "ads": (r"doubleclick", r"googlesyndication", r"googleadservices", r"ad\d+\.", r"/ads?/", r"/advert", r"banner[^/]*ad"),
    "placeholders": (r"placeholder", r"blank\.(gif|png|jpg)", r"empty\.(gif|png|jpg)", r"default[^/]*avatar", r"no[^/]*image"),
    "avatars": (r"avatar", r"profile[^/]*pic", r"user[^/]*thumb", r"/avatars?/"),
    "thumbnails": (r"_thumb\.", r"-thumb\.", r"_small\.", r"-small\.", r"_thumbnail\.", r"/thumbnails?/", r"\?[^#]*size=s", r"\?[^#]*w=\d{1,2}&"),
}
INCLUDE_PATTERNS = {
    "full_size": (r"_full\.", r"-full\.", r"_large\.", r"-large\.", r"_original\.", r"/originals?/", r"/full/"),
    "high_res": (r"@2x\.", r"@3x\.", r"_hd\.", r"-hd\.", r"_hq\.", r"[_-]2k\.", r"[_-]4k\.", r"/hires?/"),
    "galleries": (r"/gallery/", r"/photos?/", r"/images?/", r"/pictures?/", r"/media/"),
    "content": (r"/content/", r"/articles?/", r"/posts?/", r"/uploads?/"),
}
DIMENSION_PRESETS = {
    "any": {"min_width": 0, "min_height": 0}, "no_tiny": {"min_width": 32, "min_height": 32}, "no_small": {"min_width": 100, "min_height": 100},
    "medium_plus": {"min_width": 300, "min_height": 200}, "large_only": {"min_width": 800, "min_height": 600}, "hd_plus": {"min_width": 1280, "min_height": 720},
    "full_hd_plus": {"min_width": 1920, "min_height": 1080}, "four_k_plus": {"min_width": 3840, "min_height": 2160},
    "squarish": {"min_aspect_ratio": 0.8, "max_aspect_ratio": 1.2}, "landscape": {"min_aspect_ratio": 1.3}, "portrait": {"max_aspect_ratio": 0.8},
    "banner": {"min_aspect_ratio": 2.5, "min_width": 600}, "photo": {"min_width": 200, "min_height": 150, "min_aspect_ratio": 0.5, "max_aspect_ratio": 3.0},
}
#: Upper bounds of pixel counts: tiny, small, medium; the rest is large.
SIZE_BOUNDS = {"tiny": 32 * 32, "small": 300 * 200, "medium": 1280 * 720}
VARIANT_PATTERNS = (r"(?i)[-_](small|medium|large|thumb|preview|full|original)", r"(?i)[-_]\d+x\d+", r"(?i)[-_](s|m|l|xl|xxl)", r"(?i)@\d+x", r"(?i)\?[^#]{0,200}(?:size|width|height|w|h)=")
BASE_NAME_SUFFIXES = (r"(?i)[-_](small|medium|large|thumb|thumbnail|preview)\z", r"(?i)[-_]\d+x\d+\z", r"(?i)[-_](s|m|l|xl|xxl)\z", r"(?i)@\d+x\z")

# ---- security ------------------------------------------------------------------------------------------------------
BUILT_IN_BLOCKLISTS = {
    "malware": ("malware-distribution.example", "dropper.malicious"),
    "phishing": (),
    "tracking": ("pixel.facebook.com", "pixel.admob.com", "tracking.pixel", "beacon.krxd.net", "pixel.quantserve.com", "pixel.mathtag.com", "secure-gl.imrworldwide.com", "b.scorecardresearch.com", "pixel.wp.com"),
    "ads": ("ads.example", "adserver.example"),
    "cryptominers": ("coin-hive.com", "coinhive.com", "jsecoin.com", "crypto-loot.com", "cryptoloot.pro", "minero.cc", "webmine.pro"),
}
SUSPICIOUS_TLDS = tuple("tk ml ga cf gq xyz top club work date racing win bid stream download loan men click link trade party science review country kim cricket webcam faith accountant".split())
#: Look-alike letter -> the ASCII letter it looks like.
CONFUSABLES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "α": "a", "ε": "e", "ι": "i", "ο": "o", "ρ": "p", "υ": "u",
    "χ": "x", "ı": "i", "ɡ": "g", "ɑ": "a", "բ": "b", "դ": "d", "զ": "g", "հ": "h", "ո": "n", "օ": "o", "ā": "a", "ē": "e", "ī": "i", "ō": "o", "ū": "u",
}
SCRIPT_PATTERNS = (
    r"<script", r"javascript:", r"on[a-z]{1,20}\s{0,10}=", r"data:text\/html", r"vbscript:", r"expression\s{0,10}\(", r"url\s{0,10}\(\s{0,10}['\"]?\s{0,10}javascript",
    r"<img[^>]{0,500}onerror", r"<svg[^>]{0,500}onload", r"<iframe", r"<object", r"<embed",
)
PIXEL_PATTERNS = (
    r"pixel\.gif", r"pixel\.png", r"tracking\.gif", r"beacon\.gif", r"spacer\.gif", r"clear\.gif", r"1x1\.gif", r"transparent\.gif", r"\.gif\?[^#]{0,200}tracking",
    r"\/pixel\?", r"\/beacon\?", r"\/track\?",
)
SUSPICIOUS_PARAMS = ("data", "payload", "token", "session", "auth", "key", "secret", "password", "pw", "pass", "user", "email", "cookie", "creds", "credentials")
SEVERITY_WEIGHTS = {"critical": 100, "high": 75, "medium": 50, "low": 25}
TYPE_MULTIPLIERS = {"script-injection": 1.5, "blocked-domain": 1.3, "blocked-ip": 1.3, "data-exfil": 1.2, "homograph": 1.1}
#: A second, exported scale that scoring does not use.
EXPORTED_SEVERITY_WEIGHTS = {"critical": 40, "high": 25, "medium": 15, "low": 5}
DETECTIONS = ("homograph_attacks", "suspicious_tlds", "obfuscated_urls", "tracking_pixels", "data_exfiltration", "script_injection")
VALIDATION_DEFAULTS = {"require_https": False, "allow_data_urls": True, "allow_blob_urls": True, "allow_private_ips": False, "allow_localhost": False, "max_url_length": 2048, "max_query_params": 50, "max_redirects": 3}
SECURITY_PRESETS = {
    "paranoid": {"mode": "strict", "strip_tracking": True, "validation": {"require_https": True, "allow_data_urls": False, "max_url_length": 2048, "max_query_params": 20, "max_redirects": 1, "max_encoding_ratio": 0.2}},
    "balanced": {"mode": "balanced", "strip_tracking": True, "validation": {"require_https": False, "allow_data_urls": False, "max_url_length": 8192, "max_query_params": 50, "max_redirects": 3, "max_encoding_ratio": 0.3}},
    "minimal": {
        "mode": "permissive", "strip_tracking": False, "allow_private_ips": True, "allow_data_urls": True,
        "detection": {"suspicious_tlds": False, "obfuscated_urls": False, "tracking_pixels": False, "data_exfiltration": False},
        "validation": {"allow_data_urls": True, "allow_private_ips": True, "allow_localhost": True, "max_url_length": 16384, "max_query_params": 100, "max_redirects": 5, "max_encoding_ratio": 0.5},
    },
    "disabled": {"mode": "disabled"},
}
#: Other names that users know the presets by.
SECURITY_PRESET_ALIASES = {"strict": "paranoid", "permissive": "minimal"}
DANGEROUS_TAGS = tuple("script iframe object embed form input button textarea select style link meta base applet frame frameset layer ilayer bgsound title head html body".split())
DANGEROUS_ATTRIBUTES = tuple(
    "onclick ondblclick onmousedown onmouseup onmouseover onmouseout onmousemove onkeydown onkeyup onkeypress onfocus onblur onchange onsubmit onreset onselect "
    "onload onunload onerror onabort onresize onscroll ondrag ondragend ondragenter ondragleave ondragover ondragstart ondrop oncontextmenu oncopy oncut onpaste "
    "oninput oninvalid onsearch ontouchstart ontouchmove ontouchend ontouchcancel onpointerdown onpointerup onpointermove onanimationstart onanimationend "
    "onanimationiteration ontransitionend formaction xlink:href data-bind".split()
)
