"""Template residue, filler, error pages and demands for scripts in place of content.

Every line of every text is normalised (case and white space; in evidence numbers too) and counted by host. Lines on more than BOILERPLATE_SHARE
of a host's documents are its boilerplate (navigation, footers) and are subtracted. What is left of a document is its
residual: its lines with evidence, and content. A document whose residual holds evidence is residue. Evidence may be boilerplate
too (a footer that asks for scripts): a line that stands beside more content than evidence on as large a share of a
host's documents is subtracted from those; a page of which nothing else is left is judged by it, however often it occurs.

Evidence is found sentence by sentence, by features:

placeholder  an unfilled field ({{x}}, ${x}, <%= x %>, <<x>>, %x%, __x__, [insert x], (x here), a format string), or a
             sentence made of blanks (NaN, None, N/A, ___, ??, XXX) where values belong;
filler       pseudo-Latin by its share of stems, one or two words repeated, an announcement of sample text, an order to replace it;
error        codes, traces and error objects by their syntax; else points for what a sentence joins: a failure, a thing that
             fails (page, server, session), a request of a reader, an apology, brevity;
script       what runs in a browser together with its being off, missing or asked for.

The concepts are word lists in several languages, fixed values; what decides is how many of them a sentence joins, so wordings need not
be known. A sentence with points for LIKELY counts only in a line without more text of other kinds. Sentences that report such
things (past tenses, quotation, examples, percentages, words of studies) and have seven words or more are no evidence.
Markers and syntax of LaTeX, Markdown and [CITATION] are no fields.

Defined cases: null, empty and blank texts are no residue; a null host is a host of its own; repeated documents are
judged each, but count once for what recurs beside content; texts are read whole. Texts are never shuffled, only hashes
of lines; counts are combined before the shuffle, and documents of a hot host are spread over its copies.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

try:
    import ahocorasick
except ImportError:  # each sign is searched for by itself then
    ahocorasick = None
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.session import checkpointed, salted_lookup

#: A line is boilerplate of a host if it is on more than this share of its documents, at so many standard deviations.
BOILERPLATE_SHARE, Z = 0.05, 3.0

_I = re.IGNORECASE
_NAME = r"[A-Za-z][\w .\-]{0,40}"
#: Unfilled fields whose syntax leaves no doubt.
FIELD = re.compile(
    r"\{\{+\s*[\w#/^>&][\w .\-|]{0,60}\}\}+|\{%-?\s*[\w .\-]{1,60}-?%\}|<%=?\s*[\w .\-]{1,60}%>|<\?(?:php|=)?\s*(?:echo\s+)?\$?[\w .\->]{1,60}\?>|<<\s*[\w .\-]{1,60}>>|\$\{\s*[\w .\-]{1,60}\}"
    rf"|\$\({_NAME}\)|@@{_NAME}@@|(?<![\w#])#{_NAME}#(?![\w#])|«\s?{_NAME}\s?»|\[\[{_NAME}\]\]"
    r"|(?<![\w%])%[A-Za-z][\w .]{1,40}%(?![\w%])|(?<!\w)__[A-Za-z][A-Za-z0-9 ._]{1,40}__(?!\w)"
    r"|[\[(<{]\s*(?:please\s+)?(?:insert|enter|add|type|fill in|your|put)\s*[\w ./\-]{1,60}[\])>}]|\([\w .]{2,40}\bhere\)|\[[\w .]{2,40} here\]|\[(?:TODO|TBD|TBA|FIXME)\b[^\]]{0,60}\]",
    _I,
)
#: Fields in single brackets of any kind: also syntax of other things, so the sentence has to be built around them.
SOFT_FIELD = re.compile(
    r"(?<![\\\w}=^_$])\{[A-Za-z][\w .]{1,40}\}(?![\w{])|(?<![\w<])<[A-Za-z][\w .]{1,40}>(?![\w>])|\{\d*(?::[.\d]*[sdf])?\}|#\{\w+\}|(?<![\w$\\])\$\d(?![\d.,]|\w*\$)"
    r"|(?<![\w%])%\d*[sdif]\b|\[(?!CITATION\]|MASK\]|SEP\]|CLS\]|PAD\]|UNK\])[A-Za-z][\w .]{2,40}\](?!\()",
    _I,
)
HTML_TAG = re.compile(r"</?(?:a|b|i|u|p|em|strong|div|span|br|hr|ul|ol|li|td|tr|th|table|sub|sup|code|pre|h[1-6]|img|sep|cls|pad|mask|unk|s|eos|bos)\s*/?>", _I)
BLANK = re.compile(r"(?<![\w.])(?:NaN|None|null|nil|undefined|N/A|\[object Object\]|#REF!|#N/A|#VALUE!|#NAME\?|X{2,}|_{2,}|\?{2,}|\.{3,}|#{3,}|-{3,}|\[\s*\]|\{\s*\})(?!\w)", re.I)
#: Stems of the customary pseudo-Latin.
LATIN = (
    "lorem ipsum dolo amet conse adipi elit eius temp incid labor magna aliq enim mini veni quis nostr exerc ulla nisi comm duis aute irur "
    "repre volup veli cill fugi null paria excep occae cupid proid culp offic deser moll anim seddo exeac sitan utenim sint sunt"
).split()

# The concepts below are what notices are made of. A sentence is judged by which of them it joins, not by its wording.
#: What a notice is about.
THING = re.compile(
    r"\b(?:pages?|sites?|website|web ?page|urls?|links?|address|files?|documents?|pdf|articles?|papers?|records?|items?|entry|entries|abstract|contents?|resources?|previews?|attachments?|references?|viewer|reader|widget|app|application|object|homepage"
    r"|servers?|services?|hosts?|gateway|connection|network|database|archive|index|system|requests?|quer(?:y|ies)|lookups?|search|sessions?|accounts?|passwords?|logins?|ip|quota|rate limit|access|permissions?|identifiers?|dois?|institution|subscriptions?|templates?|login"
    r"|seite|dokument|artikel|server|dienst|datei|eintrag|adresse|anfrage|zugriff|page|fichier|serveur|l.article|article|requête|adresse|accès|página|documento|artículo|archivo|servidor|servicio|registro|recurso|enlace|solicitud|acceso|pagina|arquivo|artigo|ficheiro)\b"
    r"|ページ|ファイル|サーバー?|サイト|リンク|페이지|서버|파일|문서|页面|頁面|文件|服务器|网页|網頁",
    _I,
)
#: Ways in which a thing fails that ordinary prose hardly uses.
FAILS = re.compile(
    r"\b(?:went wrong|impossible (?:de |d.)(?:afficher|charger|trouver|accéder|ouvrir)|no se puede (?:mostrar|abrir|acceder|encontrar|cargar)|(?:kann|konnte) nicht (?:\w+ )?(?:angezeigt|geöffnet|geladen|gefunden)|errors? (?:has |have )?occurred|(?:can.?t|cannot|can not|couldn.?t|could not|unable to|failed to) (?:be )?(?:found|find (?!an? |any |evidence|no )|locate[d]?|load(?:ed)?|open(?:ed)?|display(?:ed)?|render(?:ed)?|reach(?:ed)?|connect|retrieve[d]?|process(?:ed)?|complete[d]?|start|access(?:ed)?|read)"
    r"|(?:page|file|document|url|address|resource|article|record|identifier|object|item|abstract|paper|site|host|entry|content)(?: is| was|)(?:n.t| not) (?:be |currently )?(?:found|available|recogni[sz]ed)|(?:technical|server) (?:difficult\w+|problems?)|connect(?:ion)? (?:error|failure)|that.s an error|error (?:establishing|connecting|loading|opening|reading|processing)|do(?:es)?(?: not|n.t) have (?:the |sufficient )?(?:permissions?|access|rights)|you have been (?:logged|signed) out|not found on this|nothing (?:was )?found|0 (?:results|hits|matches)|no (?:results?|records?|documents?|matches|entries) (?:were )?(?:found|matched|match)|do(?:es)?(?: not|n.t) exist|no longer (?:available|online|exists?|here)"
    r"|access (?:is |was |to \w+ (?:is )?)?(?:denied|forbidden|restricted|blocked)|permission (?:is )?(?:denied|required)|not (?:authori[sz]ed|allowed to|permitted to|logged in)|unauthori[sz]ed|forbidden|too many (?:requests|connections)|sending \w+ too fast|rate limit(?:ed)?|requests? (?:was |has been )?(?:throttled|blocked|denied|timed out)|quota (?:is |has been )?(?:used up|exceeded|reached)"
    r"|(?:bad|proxy|gateway) (?:gateway|request|error|time-?out)|internal server error|service (?:is )?(?:temporarily )?unavailable|temporarily (?:unavailable|down|offline|out of service)|currently (?:unavailable|down|offline|under)|(?:is|are|be) (?:down(?! the)|offline|under maintenance|being rebuilt)\b|password protected|zero pages|(?:session|link|token|page|password)(?: has| is)? expired"
    r"|does not subscribe|ip (?:address )?(?:has been|is|was) blocked|are not a robot|out of memory|lookup failed|connection (?:refused|reset|timed out|closed)|(?:has|have) been (?:moved|deleted|removed|blocked|suspended|disabled|moved or deleted)|withdrawn from this|missing from (?:our|the|this) (?:archive|server|site|index)"
    r"|nicht (?:gefunden|verfügbar|erreichbar|gefunden werden|vorhanden|geladen werden)|existiert nicht|zugriff verweigert|vorübergehend|introuvable|indisponible|non trouvée?|n.existe (?:pas|plus)|accès (?:refusé|interdit)|n.a pas (?:été|pu)|n.est pas|est réservée? aux|no (?:se (?:ha )?(?:encontr\w+|pudo)|encontrad[oa]|existe|disponible|está disponible)|no está|acceso denegado|não (?:foi )?encontrad[oa]|non (?:è stata )?trovat[oa]|pagina non)\b"
    r"|見つかりません|見つかりませんでした|存在しません|利用できません|찾을 수 없|존재하지 않|사용할 수 없|找不到|未找到|不存在|无法(?:访问|找到|显示)|無法|拒绝访问",
    _I,
)
#: Ways of failing that prose uses too: they count together with a thing or a reader.
MAY_FAIL = re.compile(
    r"\b(?:not found|failed|failure|unavailable|missing|moved|deleted|removed|withdrawn|expired|blocked|denied|restricted|throttled|exceeded|corrupt(?:ed)?|damaged|encrypted|offline|down|paused|timed? ?out|closed|empty|not (?:available|recogni[sz]ed|readable|supported|loaded|load)|stays empty|used up|(?:requires?|requiere|nécessite|benötigt|erfordert) (?:an? |una? |une? |eine? )?(?:\w+ )?(?:password|subscription|login|account|payment|authori[sz]ation|authentication|permission|contraseña|suscripción|cuenta|sesión|permiso|autorización|identificación|compte|abonnement|mot de passe|authentification|autorisation|anmeldung|konto|passwort|abo)|erforderlich|nur für|overloaded|invalid|temporalmente|fehlgeschlagen|échoué|falló)\b",
    _I,
)
#: Requests that notices make of a reader.
PROMPT = re.compile(
    r"\b(?:(?:please )?try (?:again|later|reloading)|retry in|please wait|one moment|just a moment|hold on|(?:sign|log) ?in\b.{0,24}\b(?:to|with|first)|login needed|please (?:sign|log) ?in|(?:verify|confirm|prove) (?:that )?you(?:.re| are)|checking (?:your|if the)|(?:come|check) back (?:later|soon|again)|verifying (?:you|your|that)|confirming your|security check|not a robot|you are (?:a )?human|captcha|complete the (?:challenge|captcha|check)|tick the box"
    r"|(?:reload|refresh) (?:the|this|your) (?:page|viewer|browser|site|window)|return to (?:the )?(?:home|main|start|previous|search)|back to (?:the )?(?:home|start|main)|(?:go|going) back|back (?:shortly|soon)|(?:check|verify) the (?:address|url|identifier|spelling|link)|did you (?:mis)?(?:type|spell|mean)|contact (?:the|your|us|support|our)\b|do not close|(?:thank you )?for your patience|be patient|purchase this|buy this|subscribe to (?:read|view|continue)|members may|ask the (?:owner|administrator)|download it to|see this\b|looking for\b"
    r"|versuchen sie|melden sie|wenden sie|bitte (?:prüfen|warten|laden)|zurück zur|startseite|zu einem späteren|veuillez|réessayer|(?:vous|s.)identifier|vous identifier|patienter|retour à|plus tard|inténte\w+|vuelva|volver al|inicie sesión|identifíquese|consulte al|más tarde|por favor|tente novamente|riprova)\b"
    r"|お待ちください|もう一度|再度|나중에|다시 시도|잠시|请稍[后候]|重试|稍後",
    _I,
)
APOLOGY = re.compile(
    r"^\W*(?:(?:we(?:.re| are) )?(?:very |so )?sorry(?! to say)|oops|whoops|uh-?oh|oh no|apologies|we apologi[sz]e|désolée?s?|lo sentimos|entschuldigung|desculpe|spiacenti|ops)\b"
    r"|^\W*(?:unfortunately|leider|error|fehler|erreur|warning|notice|hinweis|aviso|avis)\s*(?:[:.!,]|$)|^申し訳|^죄송|^抱歉|^对不起",
    _I,
)
#: What points at the page itself or at its reader.
DEIXIS = re.compile(r"\b(?:this|your|you|requested|our|diese[rs]?|angeforderte\w*|gesuchte\w*|cette?|demandée?|est[ea]|solicitad[oa]|this)\b", _I)
WAITING = re.compile(r"^\W*(?:loading|fetching|starting|redirecting|connecting|processing|laden|chargement|cargando|please wait|wird geladen|読み込み中|로딩|加载中)\b.{0,30}$|^\W*(?:loading|fetching|starting|redirecting)\s+(?:the )?(?:viewer|reader|page|document|pdf|content)", _I)
READER = re.compile(r"\b(?:you|your|yours|please|kindly|sie|ihr|ihre[nmrs]?|bitte|vous|votre|vos|veuillez|usted|su|por favor|você|seu)\b|ください|하십시오|하세요|请", _I)
#: What runs in a browser, and what is asked of it.
SCRIPT = re.compile(r"\b(?:java\s?scripts?|js|scripts?|scripting|active content|cookies?|skripte?n?|noscript|ad[ -]?block(?:ers?|ing)?|(?:your|the|this|ihr|votre|su|modern|supported|another|different) browsers?|browser (?:is|cannot|does|you use)|navegador|navigateur)\b|JavaScript|자바스크립트|クッキー", _I)
ABLE = re.compile(
    r"\b(?:enabl\w*|activat\w*|re-?enable|allow(?:ed|s|ing)?|permit\w*|(?:turn|switch)(?:ed|ing)? (?:it |them |\w+ )?(?:on|off)|disabl\w*|block(?:ed|s|ing)?|requir\w*|needs?|needed|necessary|must be|have to|not (?:supported|detected|enabled|available|load)|(?:is|are|seems?(?: to be)?) (?:off|on|disabled|blocked|turned off)|unsupported|too old|out of date|outdated|upgrade|update|cannot (?:render|display|run|start)|does not support|(?:un)?support(?:s|ed)?|accept"
    r"|aktivier\w*|einschalten|zulassen|zuzulassen|erlauben|benötig\w*|erforderlich|müssen|ohne|activ\w*|autoris\w*|nécessit\w*|requiert|requis|doit|désactiv\w*|habilit\w*|permit\w*|necesit\w*|requier\w*|necess\w*|desactiv\w*|ative|abilit\w*|attiv\w*|refresh|first|then)\b|有効|활성화|启用|啟用|开启",
    _I,
)
MODERN = re.compile(r"\binstall a (?:modern|newer|current|different)\b|\bupdate your browser\b|\b(?:reader|viewer|app|application|page|site) (?:cannot|can.t|will not|won.t) (?:start|load|work|display|run)\b|\bsome (?:features|parts|functions) (?:will|may) not work\b|\bbrowser (?:is|you use|cannot|can.t|does not|has).{0,40}(?:support|old|outdated|render|display|run)", _I)
#: Code and protocols.
STATUS = re.compile(
    r"\b(?:https?|status|error|fehler|erreur|code|errore?)(?:[\s/:#-]+(?:\d\.\d|error|status|code))*[\s:#-]*[45]\d\d\b|^\W*[45]\d\d\s*[-:–|]?\s*(?:\w+ )?(?:not found|forbidden|error|bad|service|unauthori[sz]ed|gateway|too many|gone|request|proxy|internal|time-?out|access|page|unavailable)\b"
    r"|\b(?:\w+ )?(?:not found|forbidden|unauthori[sz]ed|server error|gateway|unavailable|time-?out|too many requests|bad request|gone)\s*[(:\[-]\s*\(?(?:error |code |http )*[45]\d\d\b",
    _I,
)
TRACE = re.compile(
    r"^\s*traceback \(most recent|^\s*file \"[^\"]+\", line \d+|^\s*(?:caused by:?\s*)?(?:[\w$]+\.)+\w*(?:Exception|Error)\b|^\s*\w+(?:Error|Exception)(?::\s|$)|^\s*exception in thread|^\s*at [\w.$<>]+\([\w.$]*(?:\.\w+:\d+|native method|unknown source)?\)|^\s*(?:unhandled|uncaught) (?:exception|error|\w+error)"
    r"|^\s*(?:php )?(?:fatal error|parse error|segmentation fault|stack ?trace|core dumped|kernel panic|runtime failure)\b|^\s*(?:notice|warning|error|fatal)\s*:\s+(?:[a-z_]+\(\)|undefined|uncaught|unexpected|call to|division by|cannot|allowed memory|maximum|template|database|out of|too many|connection|[\w. ]+(?:exception|failed|not readable|exhausted))|^\s*panic: |^\s*npm err!",
    _I,
)
JSON_ERROR = re.compile(r"^\W{0,2}\{\s*\"(?:error|errors|status|statuscode|message|ok|code|detail|reason|fault|success|title|type)\"\s*:.{0,400}(?:error|fail|denied|forbidden|not found|unavailable|exceed|limit|quota|false|invalid|unauthori|expired|gone|missing|timeout|timed out|[45]\d\d)", _I)
#: Announcements of sample text, and orders to replace it.
SAMPLE = re.compile(r"\b(?:sample|mock|dummy|demo|example|temporary|placeholder|filler|fake|test|boilerplate|blind)\s+(?:\w+ )?(?:text|copy|content|wording|paragraph|abstract|sentence|title|page)\b", _I)
SAMPLE_USE = re.compile(r"^\W*(?:this|here|just|below|you are reading|the following|some|more|only|nothing but|a |an )|\b(?:fill the page|for layout|layout only|nothing more|designer|(?:will|to) be replaced|until the (?:real|final|actual)|goes here)\b", _I)
ORDER = re.compile(
    r"^\W*(?:please\s+)?(?:replace|overwrite|substitute|insert|enter|type|add|write|paste|put|fill|edit|delete|use)\b.{0,40}\b(?:your|here|below|the (?:final|real|actual)|this (?:line|text|paragraph|space|box|field)|before submission)\b|^\W*(?:your|the|an?)?\s*\b\w+(?: \w+)? (?:goes here|to follow|to be (?:added|written|supplied)|here)\W*$"
    r"|^\W*(?:TODO|TBD|TBA|FIXME|XXX|to do)\b\s*(?:[-:–—]|$|\()|^\W*\(pending\)|^\W*\(?(?:pending|to be (?:written|added|completed|filled in|announced|determined|confirmed))\b.{0,30}$|^FIXME\b|^\w+: <[\w/. -]{1,40}>\W*$",
    _I,
)
#: What reports of such things have and the things themselves have not: verbs of studies, past tenses, quotation, examples, percentages, pages in the plural.
REPORT = re.compile(
    r"\b(?:were(?! looking)|had|they|responses|appeared|answered|observed|measured|counted|labelled|rendered|removed from"
    r"|we (?:also |then |first )?(?:study|propose|present|show|find|found|use|train|evaluate|measure|report|observe|follow|compare|analy[sz]e|remove|collect|sample|replace|count|describe|introduce|argue|investigate|examine|consider|treat|exclude|keep|discard|drop|crawl|retr(?:y|ied))\w*"
    r"|such as|for example|e\.g\.|so-called|in which|of which|after which|whether|how \w+|(?<![a-z] )their|that ask|said|says|stud(?:y|ies)|suggests?|corpus|dataset|experiments?|models?|method|annotators?)\b|\[CITATION\]|\d%|\\\\(?:cite|ref)",
    _I,
)
#: What sentences about fields and markers have: words for the notation itself.
NOTATION = re.compile(r"\b(?:templates?|slots?|placeholders?|tokens|vocabulary|syntax|notation|variables?|(?:are|is) (?:written|expanded|replaced|denoted|rendered) (?:as|by|with)|denotes?|such as|for example|e\.g\.|like)\b", _I)
SENTENCE = re.compile(r"(?<=[.!?…])[\"')\]]*\s+")
WORD = re.compile(r"[^\W\d_]+")
#: Cheap signs without which a sentence can hold no field, no blank; those of blanks in lower case.
FIELD_SIGN = re.compile(r"[{«]|<[\w<%?/ ]|%\w|\[(?!CITATION\])[A-Za-z\[ ]|\$[{(\d]|here\)|\(\s*(?:please|insert|enter|add|type|fill|your|put)|@@|#\w|__", _I)
BLANK_SIGNS = ("nan", "none", "null", "nil", "undefined", "n/a", "xx", "__", "??", "...", "###", "---", "[object", "#ref", "#value", "#name", "[]", "{}", "[ ", "{ ")
LATIN_STEMS = tuple(LATIN)
#: The same for pseudo-Latin, samples, traces, scripts, failures and requests: parts of words, one of which each alternative above has.
LATIN_SIGNS = tuple("ipsum dolor amet consect adipi eiusmo tempor labore aliqu venia nostru ullamc commod irure repreh volupt velit fugiat pariat excepte occaec cupidat proident deserun mollit laborum".split())
SAMPLE_SIGNS = tuple("sample mock dummy demo example temporary placeholder filler fake test boilerplate blind".split())
TRACE_SIGNS = ("rror", "xception", "traceback", "file \"", "at ", "notice", "warning", "panic", "core", "trace", "segmentation", "failure", "fatal")
SCRIPT_SIGNS = ("script", "skript", "js", "active content", "cookie", "browser", "ad block", "adblock", "ad-block", "navegador", "navigateur", "install a", "start", "load", "not work", "not display", "not run", "スクリプト", "자바스크립트", "クッキー")
FAIL_SIGNS = (
    "wrong", "occurred", "can't", "can’t", "cannot", "can not", "couldn", "could not", "unable", "fail", "not found", "nothing", "avail", "recogni", "exist", "longer", "denied", "forbid", "restrict", "block", "permission", "authori", "not allowed", "not permitted", "not logged",
    "n't ", "n’t ", "difficult", "problem", "connect", "an error", "impossible", "no se puede", "logged out", "signed out", "too many", "too fast", "rate limit", "throttl", "quota", "gateway", "bad request", "server error", "proxy", "temporar", "currently", "offline", " down", "maintenance", "rebuilt", "password", "zero pages", "expired", "subscri", "robot", "memory", "lookup", "connection", "moved", "deleted",
    "suspended", "disabled", "withdrawn", "missing", "nothing", "no result", "no record", "no document", "no match", "no entr", "0 results", "0 hits", "0 matches", "exceeded", "corrupt", "damaged", "encrypted", "paused", "timed out", "timed-out", "timeout", "time-out", "time out", "closed", "empty", "readable", "supported", "not load", "used up", "overload", "invalid",
    "nicht", "verweiger", "vorüber", "erforder", "nur für", "fehlgeschl", "erfordert", "benötigt", "introuvable", "indisponible", "trouv", "accès", "pas ", "réservé", "échou", "nécessite", "encontr", "pudo", "no existe", "disponible", "no está", "acceso", "requiere", "temporalmente", "falló", "não ", "pagina",
    "見つか", "存在", "利用", "찾을", "존재", "사용할", "找不到", "未找到", "不存在", "无法", "無法", "拒绝",
)
PROMPT_SIGNS = (
    "come back", "check back", "again", "later", "reload", "refresh", "retry", "wait", "moment", "hold on", "sign in", "sign-in", "log in", "login", "verif", "confirm", "prove", "checking", "security check", "robot", "human", "captcha", "complete the", "tick the", "return to", "back", "address", "url", "identif", "spell", "mistype", "did you", "contact", "do not close",
    "patien", "purchase", "buy this", "subscribe", "members may", "owner", "administrat", "download it", "see this", "looking for", "versuchen", "melden", "wenden", "bitte", "zurück", "startseite", "späteren", "veuillez", "réessay", "retour", "plus tard", "intént", "vuelva", "volver", "inicie", "consulte", "más tarde", "por favor", "novamente", "riprova",
    "お待ち", "もう一度", "再度", "나중에", "다시", "잠시", "请稍", "重试", "稍後",
)
STATUS_SIGNS = ("http", "rror", "status", "code", "fehler", "erreur", "not found", "forbid", "authori", "gateway", "unavail", "timeout", "time-out", "too many", "bad ", "gone", "request", "proxy", "internal", "service", "access", "page")
ORDER_SIGNS = (
    "your", " here", "below", "final", "actual", "the real", "this line", "this text", "this paragraph", "this space", "this box", "this field", "before submission", "to follow", "to be ", "todo", "tbd", "tba", "fixme", "xxx", "to do", "pending", ": <",
)
#: Of notices that begin with an apology, a label, or waiting.
OPENING_SIGNS = (
    "sorry", "oops", "whoops", "uh-oh", "uhoh", "oh no", "apolog", "unfortunately", "error", "fehler", "erreur", "warning", "notice", "hinweis", "aviso", "avis", "désol", "sentimos", "entschuldigung", "leider", "desculpe", "spiacenti", "ops",
    "申し訳", "죄송", "抱歉", "对不起", "loading", "fetching", "starting", "redirecting", "connecting", "processing", "laden", "chargement", "cargando", "please wait", "読み込み中", "로딩", "加载中",
)
SIGNS = {"status": STATUS_SIGNS, "order": ORDER_SIGNS, "opening": OPENING_SIGNS, "blank": BLANK_SIGNS, "latin": LATIN_SIGNS, "sample": SAMPLE_SIGNS, "trace": TRACE_SIGNS, "script": SCRIPT_SIGNS, "fail": FAIL_SIGNS, "prompt": PROMPT_SIGNS}
CODE = re.compile(r"(?<!\d)[45]\d\d(?!\d)")
#: Points at which a sentence is evidence by itself, and at which it is in a line without other text.
SURE, LIKELY = 4, 3


def latin_share(words: list[str]) -> float:
    return sum(w.startswith(LATIN_STEMS) for w in words) / max(len(words), 1)


def signed(low: str, signs: list[str] | tuple[str, ...]) -> bool:
    return any(map(low.__contains__, signs))


def _automaton() -> object | None:
    """All signs in one automaton, by which a text is searched once; None where the library is missing."""
    if ahocorasick is None:
        return None
    found = ahocorasick.Automaton()
    for sign in {x for v in SIGNS.values() for x in v}:
        found.add_word(sign, sign)
    found.make_automaton()
    return found


_FINDER = _automaton()


def signs_of(text: str) -> dict[str, list[str]]:
    """The signs that a text has at all: only these are looked for in its sentences."""
    low = text.lower()
    if _FINDER is None:
        return {k: [x for x in v if x in low] for k, v in SIGNS.items()}
    here = {sign for _, sign in _FINDER.iter(low)}
    return {k: [x for x in v if x in here] for k, v in SIGNS.items()}


def may_hold_field(core: str) -> bool:
    """What FIELD_SIGN finds, by characters first: most sentences have none of them but the marker of a citation."""
    return any(map(core.replace("[CITATION]", "").__contains__, "{«<%[$@#_(")) and bool(FIELD_SIGN.search(core)) or "here)" in core.lower()


def bare(s: str) -> str:
    """A sentence without quotation marks around it and without marks of headings, lists and quotations."""
    core = s.strip().strip("\"'`“”")
    return re.sub(r"^(?:#+\s+|[*>\-•]+\s+)", "", core).strip() if core[:1] in "#*>-•" else core


def scored(core: str, signs: dict = SIGNS) -> tuple[str | None, int]:
    """(kind, points) of one bare sentence."""
    low = core.lower()
    kind, points = _field(core, low, signs)
    if kind:  # the fields themselves do not tell whether a sentence speaks about fields
        if len(WORD.findall(core)) >= 7 and NOTATION.search(SOFT_FIELD.sub(" ", FIELD.sub(" ", core))):
            return None, 0
        return kind, points
    kind, points = _filler(core, low, signs)
    if not kind:
        kind, points = _notice(core, low, signs)
    if kind and len(WORD.findall(core)) >= 7 and REPORT.search(core):
        return None, 0
    return kind, points


def _field(core: str, low: str, signs: dict) -> tuple[str | None, int]:
    if signs.get("field", True) and may_hold_field(core):
        fields = FIELD.findall(core)
        if fields:  # several fields make a template, whatever it says; one field in a long sentence is an aside
            return ("placeholder", SURE) if len(fields) > 1 or len(WORD.findall(core)) <= 25 else (None, 0)
        if "\\" not in core and (soft := SOFT_FIELD.findall(HTML_TAG.sub("", core))):
            inside = sum(len(WORD.findall(x)) for x in soft)
            if len(soft) >= 2 or len(WORD.findall(core)) - inside <= 3:
                return "placeholder", SURE
    if signed(low, signs["blank"]) and (blanks := BLANK.findall(core)):
        words = WORD.findall(BLANK.sub(" ", core))
        if (len(blanks) >= 2 or len(words) <= 2) and len(blanks) >= 0.2 * len(core.split()) and not re.fullmatch(r"[\s.\-_#|*=:]+", core):
            return "placeholder", SURE
    return None, 0


def _filler(core: str, low: str, signs: dict) -> tuple[str | None, int]:
    if signed(low, signs["latin"]):
        words = WORD.findall(low)
        if len(words) >= 3 and latin_share(words) >= 0.5:
            return "filler", SURE
    if (signed(low, signs["sample"]) and SAMPLE.search(core) and SAMPLE_USE.search(core)) or (signed(low, signs["order"]) and ORDER.match(core)):
        return "filler", SURE
    return None, 0


def _notice(core: str, low: str, signs: dict) -> tuple[str | None, int]:
    """A notice by what it joins: a failure with a thing, a request with a reader, a browser's script with its being off."""
    if (signed(low, signs["trace"]) and TRACE.match(core)) or ("{" in core[:3] and JSON_ERROR.match(core)):
        return "error", SURE
    opening = signed(low, signs["opening"])
    sorry, waits = opening and bool(APOLOGY.match(core)), opening and bool(WAITING.match(core))
    about, fail_sign, prompt_sign = signed(low, signs["script"]), signed(low, signs["fail"]), signed(low, signs["prompt"])
    coded = bool(signed(low, signs["status"]) and CODE.search(core) and STATUS.search(core))
    if not (sorry or waits or about or fail_sign or prompt_sign or coded):
        return None, 0
    n = len(WORD.findall(core))
    if coded and (n <= 8 or STATUS.match(core) or DEIXIS.search(core) or FAILS.search(core) or PROMPT.search(core)):
        return "error", SURE + (n <= 12) - (n > 20)
    brief = (n <= 12) + (n <= 5)
    if about and (SCRIPT.search(core) and ABLE.search(core) or MODERN.search(core)):
        return "script", 2 + (n <= 20) + bool(READER.search(core)) + brief
    if waits:
        return "error", 2 + brief
    fails = fail_sign and bool(FAILS.search(core))
    may = fail_sign and not fails and bool(MAY_FAIL.search(core))
    # a few words of request without an end are a link of the site's navigation
    prompt = prompt_sign and bool(PROMPT.search(core)) and (n > 4 or core.endswith((".", "!", "?", "…", ":", "。")))
    if not (sorry or fails or may or prompt):
        return None, 0
    thing, reader = bool(THING.search(core)), bool(READER.search(core))
    points = 3 * fails + may + 2 * prompt + 2 * sorry + (thing and (fails or may)) + reader + brief - 2 * (n > 20)
    return ("error", points) if points >= LIKELY and (fails or prompt or sorry or (thing or reader) and (n <= 5 or bool(DEIXIS.search(core)) or (n <= 8 and bool(THING.match(core))))) else (None, 0)


def line_kind(line: str, signs: dict = SIGNS) -> str | None:
    """The kind of evidence in one line: of its sentences, or of the line as a whole (repeated words)."""
    head = [w.strip(".,;!?").lower() for w in line.split(None, 3)[:3]]
    if len(head) == 3 and (head[0] == head[1] or head[0] == head[2]):
        words = WORD.findall(line.lower())
        if len(words) >= 6 and len(set(words)) <= 2 and not re.search(r"\d", line):
            return "filler"
    likely, counted, other = None, 0, 0
    for s in SENTENCE.split(line):
        core = bare(s)
        if not core:
            continue
        if "any" in signs and not signed(core.lower(), signs["any"]) and not (signs["field"] and may_hold_field(core)):
            other += len(core)  # nothing of which evidence is made
            continue
        kind, points = scored(core, signs)
        if points >= SURE:
            return kind
        if points >= LIKELY:
            likely = likely or kind
            counted += len(core)
        else:
            other += len(core)
    return likely if counted >= other else None


def facts(text: str) -> list[tuple[str, str | None, int]]:
    """(normalised line, kind of evidence or None, characters) of a text, each normalised line once; numbers in evidence are alike."""
    found: dict[str, tuple[str, str | None, int]] = {}
    text = text.replace("\xa0", " ")
    here = signs_of(text)
    signs = {**here, "any": sorted({x for v in here.values() for x in v}), "field": any(map(text.replace("[CITATION]", "").__contains__, "{«<%[$@#_("))}
    for line in text.splitlines():
        line = line.strip()
        if line and (norm := " ".join(line.lower().split())) not in found:
            kind = line_kind(line, signs)
            found[norm] = (re.sub(r"\d+", "0", norm) if kind else norm, kind, len(line))
    return list({n: (n, k, c) for n, k, c in found.values()}.values())


def evidence_lines(text: str) -> list[tuple[str, str]]:
    return [(k, n) for n, k, _ in facts(text) if k]


def line_facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(k, host, whole, lines array<struct<h, kind, size>>): the lines of each document as hashes; one pass, no shuffle.

    whole is a hash of all lines, by which repeated documents count once.
    """
    d = docs.select(F.col(id_col).alias("k"), F.concat(F.lit("h"), F.col(host_col).cast("string")).alias("host"), F.col(text_col).alias("t"))
    item = pa.struct([("h", pa.int64()), ("kind", pa.string()), ("size", pa.int32())])

    def hashed(s: str) -> int:
        return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, whole, lines = [], [], []
            for i, t in enumerate(b.column(2).to_pylist()):
                if t and (found := facts(t)):
                    row.append(i)
                    lines.append([{"h": hashed(n), "kind": k, "size": c} for n, k, c in found])
                    whole.append(hashed("\n".join(n for n, _, _ in found)))
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(whole, pa.int64()), pa.array(lines, pa.list_(item))], ["k", "host", "whole", "lines"])

    kind = d.schema["k"].dataType.simpleString()
    return d.mapInArrow(run, f"k {kind}, host string, whole bigint, lines array<struct<h:bigint,kind:string,size:int>>").withColumn("host", F.coalesce("host", F.lit("")))


def recurrent(n: Column, of: Column) -> Column:
    """Whether a line on n of so many documents is on more than BOILERPLATE_SHARE of such documents, with confidence (lower Wilson bound)."""
    p, z = n / of, Z
    low = (p + z * z / (2 * of) - z * F.sqrt(p * (1 - p) / of + z * z / (4 * of * of))) / (1 + z * z / of)
    return low >= BOILERPLATE_SHARE


def residue(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(id_col, kinds array<string>): the documents whose residual holds evidence, with the kinds found."""
    found = checkpointed(line_facts(docs, id_col, text_col, host_col))
    hosts = checkpointed(found.groupBy("host").agg(F.count("*").alias("docs")))
    # all lines, counted by host; what recurs is at most 1 / BOILERPLATE_SHARE times the lines of a document of the host
    counted = found.select("host", F.explode("lines").alias("l")).groupBy("host", F.col("l.h").alias("h")).agg(F.count("*").alias("n"))
    often = counted.join(hosts, "host").where(recurrent(F.col("n"), F.col("docs"))).groupBy("host").agg(F.collect_list("h").alias("often"))
    reps = hosts.join(often, "host", "left").select("host", F.coalesce("often", F.array().cast("array<bigint>")).alias("often"), "docs")
    marked = found.where(F.exists("lines", lambda x: x["kind"].isNotNull()))
    total = lambda keep: F.aggregate(F.filter("lines", keep), F.lit(0).cast("bigint"), lambda acc, x: acc + x["size"])
    left = checkpointed(
        salted_lookup(marked.withColumn("whole_key", F.col("whole")), reps, "host", "whole_key", "docs")
        .withColumn("content", total(lambda x: x["kind"].isNull() & ~F.array_contains("often", x["h"])))
        .select("k", "host", "whole", F.explode(F.filter("lines", lambda x: x["kind"].isNotNull())).alias("l"), (F.col("content") > total(lambda x: x["kind"].isNotNull())).alias("beside"))
        .select("k", "host", "whole", "beside", "l.h", "l.kind")
    )
    # evidence that recurs beside more content than evidence is boilerplate there; a page that is nothing else is judged by it
    site = (
        left.where("beside").select("host", "h", "whole").distinct().groupBy("host", "h").agg(F.count("*").alias("n"))
        .join(hosts, "host").where(recurrent(F.col("n"), F.col("docs"))).select("host", "h")
    )
    return (
        left.join(site.withColumn("beside", F.lit(True)), ["host", "h", "beside"], "left_anti")
        .groupBy(F.col("k").alias(id_col))
        .agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    )
