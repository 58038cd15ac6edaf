"""Template residue, filler, error pages and demands for scripts where a document's own content should be."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.runtime import cut, only

# The vocabulary of residue by language (English, French, Spanish, Portuguese, German), from which sentences
# are put together. Lower case.
THINGS = r"(?:page|file|notebook|document|site|website|url|address|resource|link|content|item|article|view|viewer|server|service|fichier|carnet|adresse|ressource|contenu|serveur|página|archivo|cuaderno|documento|recurso|dirección|contenido|servidor|servicio|sitio|ficheiro|arquivo|caderno|endereço|conteúdo|serviço|seite|datei|dokument|inhalt|dienst)"
DETERMINERS = r"(?:the|this|that|your|a|any|la|le|les|cette|ce|cet|votre|l'|el|esta|este|esa|ese|su|tu|o|a|essa|esse|sua|seu|die|das|der|diese|dieses|dieser|ihre)"
GONE = [
    r"(?:was |is |were )?not found", r"(?:can ?not|can.t|could not|couldn.t) be (?:found|displayed|shown|loaded|opened|reached|rendered)", r"(?:does not|doesn.t|no longer) exists?", r"is (?:missing|gone|not available|no longer available|unavailable)", r"(?:may |might )?(?:has|have) (?:probably )?been (?:moved|deleted|removed|renamed)(?:(?:,| or) (?:moved|deleted|removed|renamed))*", r"leads nowhere",
    r"(?:est )?introuvable", r"(?:est )?non trouvée?", r"n.existe (?:pas|plus)", r"(?:a|ont) (?:peut-être )?été (?:déplacée?|supprimée?|effacée?)(?: ou (?:déplacée?|supprimée?|effacée?))?", r"n.est (?:pas|plus) disponible",
    r"no (?:se )?(?:ha sido )?(?:encontrad[oa]|encontró)", r"no existe", r"se ha movido(?: o borrado)?", r"(?:ha sido|fue) (?:movid|borrad|eliminad)[oa](?: o (?:movid|borrad|eliminad)[oa])?", r"no está disponible",
    r"não (?:foi )?encontrad[oa]", r"não existe", r"foi (?:movid|apagad|removid)[oa](?: ou (?:movid|apagad|removid)[oa])?", r"não está disponível",
    r"(?:wurde )?nicht gefunden", r"(?:gibt es|existiert) nicht(?: mehr)?", r"wurde (?:verschoben|gelöscht|entfernt)(?: oder (?:verschoben|gelöscht|entfernt))?", r"ist nicht (?:mehr )?verfügbar",
]
NONE_SUCH = [r"no such", r"we (?:can.t|can ?not|could not|couldn.t) find", r"aucune?", r"no encontramos", r"não encontr[aá]mos", r"keine?"]
DENIED = [
    r"access (?:is )?(?:denied|forbidden|restricted)", r"forbidden", r"unauthori[sz]ed", r"(?:you are|you.re) not (?:allowed|authori[sz]ed|permitted)(?: here| to [^.]{3,40})?", r"you (?:do not|don.t) have (?:the )?(?:permission|access|rights?)(?: to [^.]{3,40})?", r"permission denied",
    r"accès (?:interdit|refusé)", r"vous n.avez pas (?:le droit|la permission|l.autorisation|accès)(?: [^.]{3,40})?", r"acceso (?:denegado|prohibido)", r"prohibido", r"no tiene permisos?(?: [^.]{3,40})?", r"acesso (?:negado|proibido)", r"proibido", r"não tem permissão(?: [^.]{3,40})?",
    r"zugriff (?:verweigert|nicht erlaubt)", r"kein zutritt", r"(?:für [^.]{3,30} )?fehlt (?:ihnen )?die berechtigung", r"sie haben keine (?:berechtigung|rechte)(?: [^.]{3,40})?",
]
BROKEN = [
    r"(?:internal )?server error", r"(?:an )?unexpected error(?: (?:has )?occurred)?", r"an? (?:internal |unknown )?error (?:has )?occurred", r"something (?:went wrong|broke|is broken|has gone wrong)", r"bad (?:gateway|request)", r"gateway time-?out", r"(?:temporarily )?down for maintenance", r"(?:currently )?under maintenance", r"(?:is )?too busy", r"(?:is )?(?:temporarily |currently )?unavailable", r"(?:the )?(?:viewer|server|page|site) could not (?:render|load|open|show|display) (?:this|the) \w+",
    r"erreur (?:interne|inattendue|inconnue)(?: du serveur)?", r"(?:un )?(?:problème|erreur) est surven[ue]e?", r"(?:momentanément |temporairement )?indisponible", r"(?:en )?(?:cours de )?maintenance",
    r"error (?:interno|inesperado|desconocido)(?: del servidor)?", r"algo (?:falló|ha fallado|salió mal)", r"no disponible(?: por ahora)?", r"en mantenimiento", r"erro (?:interno|inesperado|desconhecido)(?: do servidor)?", r"algo correu mal", r"(?:temporariamente )?indisponível", r"em manutenção",
    r"(?:interner|unerwarteter|unbekannter) (?:server)?fehler", r"(?:ist )?(?:bei uns )?etwas schiefgegangen", r"(?:ist )?(?:vorübergehend )?nicht (?:verfügbar|erreichbar)", r"wartungsarbeiten",
]
BUSY = [r"too many requests", r"slow down", r"rate limit (?:exceeded|reached)", r"trop de requêtes", r"demasiadas (?:peticiones|solicitudes)", r"demasiados pedidos", r"zu viele anfragen"]
RETRY = [r"(?:please )?try again(?: later| soon| in [^.]{3,30})?", r"(?:merci de |veuillez )réessayer(?: [^.]{3,40})?", r"(?:vuelva|vuelve) a intentarlo(?: [^.]{3,40})?", r"(?:inténtelo|inténtalo) (?:de nuevo|más tarde)(?: [^.]{3,40})?", r"tente (?:de novo|novamente)(?: [^.]{3,40})?", r"(?:bitte )?(?:versuchen sie es )?später (?:noch einmal|erneut)(?: versuchen)?"]
OPENERS = r"(?:we.re |we are )?(?:sorry|oops|uh oh|hmm|ooh|whoops|désolée?|lo sentimos|lo siento|ups|pedimos desculpa|desculpe|leider|entschuldigung|hoppla)[,.!:]*\s*(?:but |mais |pero |mas |aber )?"
FILLER = [
    r"(?:more )?text (?:will follow|to follow|to be added|goes here|comes here|follows)(?: later| soon| here)?", r"(?:dummy|sample|filler|filling|placeholder|example|blind) (?:text|copy|content)(?: (?:for (?:the )?layout|here|goes here|only))?", r"this (?:paragraph|text|section|sentence|block) (?:only |just |merely )?(?:fills|takes up) (?:the |some )?(?:space|page|room)", r"(?:content|copy|description) (?:goes here|to come|coming soon)",
    r"(?:faux texte|texte (?:provisoire|factice|fictif|d.exemple|de remplissage|à venir))(?: pour la mise en page| ici)?", r"ce (?:paragraphe|texte) (?:ne )?(?:sert|fait)(?: qu.| que)?(?: ?à)? ?(?:de )?remplir (?:la page|l.espace)", r"contenu à venir",
    r"texto (?:de relleno|provisional|de ejemplo|ficticio|simulado)(?: para la maqueta| aquí)?", r"este (?:párrafo|texto) (?:solo|sólo|solamente) (?:ocupa|rellena) (?:el )?(?:espacio|página)", r"texto (?:de exemplo|provisório|de preenchimento|fictício)(?: para a maqueta| aqui)?", r"este (?:parágrafo|texto) (?:só|apenas) (?:preenche|ocupa) (?:o |a )?(?:espaço|página)",
    r"(?:blindtext|fülltext|beispieltext|mustertext|platzhaltertext|platzhalter)(?: für das layout| hier)?", r"dieser (?:absatz|text) füllt (?:nur |lediglich )?(?:den|die) (?:platz|seite)", r"(?:text|inhalt) folgt(?: später| in kürze)?",
]
KEYS = ["asdf", "asdfasdf", "qwer", "qwerty", "qwertz", "jkl", "jklö", "xxxx", "xxx", "foo", "bar", "baz", "bla", "blah", "abc", "yxcv", "zxcv", "test"]
LOREM = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
SYLLABLES = "sa ri ta la pum fe sit mo cor tur lo nus men do ve per dit es ul nam bi qui".split()
SCRIPT_WORDS = r"(?:java ?script|scripts?|skripte?|les scripts|los scripts|os scripts)"
SCRIPTS = [
    rf"(?:please |kindly |you (?:must|need to|have to|should) )?(?:have |enable|activate|allow|turn on|switch on) ?(?:{SCRIPT_WORDS}|your browser.s {SCRIPT_WORDS})(?: (?:must be )?(?:enabled|activated|turned on))?\b", rf"{SCRIPT_WORDS} (?:seems to be|seems|is|are|has been|must be|needs to be) (?:currently )?(?:switched off|turned off|disabled|off|required|blocked|not enabled|enabled|turned on|needed)", rf"your browser (?:blocks|has disabled|does not (?:run|support|allow)|doesn.t (?:run|support|allow)) {SCRIPT_WORDS}", rf"(?:this (?:page|site|website|notebook)|(?:this|the) (?:viewer|app|application)) (?:needs|requires|relies on|depends on|will not work without|does not work without|doesn.t work without) {SCRIPT_WORDS}",
    rf"(?:veuillez |merci d.|vous devez )?activer {SCRIPT_WORDS}\b", rf"cette page (?:a besoin (?:des?|du) ?|nécessite |requiert ){SCRIPT_WORDS}", rf"{SCRIPT_WORDS} (?:sont|est|semble|semblent) (?:être )?(?:bloqués?|désactivés?|coupés?|requis|nécessaires?)", rf"votre navigateur (?:bloque|n.exécute pas) {SCRIPT_WORDS}",
    rf"(?:por favor,? |debe )?(?:active|habilite|activar|habilitar) {SCRIPT_WORDS}\b", rf"(?:esta página|este sitio) (?:necesita|requiere) {SCRIPT_WORDS}", rf"(?:su|tu) navegador bloquea (?:los )?{SCRIPT_WORDS}", rf"{SCRIPT_WORDS} (?:están|está|parece) (?:estar )?(?:bloqueados?|desactivados?)",
    rf"(?:por favor,? )?(?:ative|habilite) (?:o )?{SCRIPT_WORDS}\b", rf"esta página (?:precisa|necessita) (?:de |do )?{SCRIPT_WORDS}", rf"(?:o )?seu navegador bloqueia (?:os )?{SCRIPT_WORDS}", rf"(?:o )?{SCRIPT_WORDS} (?:estão|está|parece) (?:estar )?(?:bloqueados?|desligados?|desativados?)",
    rf"(?:bitte )?{SCRIPT_WORDS} (?:aktivieren|einschalten|zulassen)", rf"diese (?:seite|anwendung) (?:braucht|benötigt|erfordert) {SCRIPT_WORDS}", rf"ihr browser blockiert {SCRIPT_WORDS}", rf"{SCRIPT_WORDS} (?:scheint|scheinen|ist|sind|muss|müssen) (?:ausgeschaltet|abgeschaltet|deaktiviert|blockiert|aktiviert)",
]
_NOUN = r"[^\W\d_][\w' -]{0,30}"
FILL_IN = [
    rf"your {_NOUN} here", rf"insert {_NOUN}( here)?", rf"add {_NOUN}( here)?", rf"replace (this )?with {_NOUN}", rf"{_NOUN} goes here", rf"enter {_NOUN} here",
    rf"votre {_NOUN} ici", rf"insérer {_NOUN} ici", rf"remplacer par {_NOUN}", rf"{_NOUN} à compléter", rf"ajouter {_NOUN}",
    rf"escriba aquí su {_NOUN}", rf"insertar {_NOUN} aquí", rf"(sustituir|reemplazar) por {_NOUN}", rf"{_NOUN} por completar", rf"su {_NOUN} aquí",
    rf"o seu {_NOUN} aqui", rf"a sua {_NOUN} aqui", rf"inserir {_NOUN} aqui", rf"substituir por {_NOUN}", rf"{_NOUN} (a|por) preencher",
    rf"hier {_NOUN} (eintragen|einfügen)", rf"durch {_NOUN} ersetzen", rf"{_NOUN} ergänzen", rf"{_NOUN} hier (einfügen|eintragen)", rf"ihr {_NOUN} hier",
]

_WORDS = "|".join(FILL_IN)
_SLOT = re.compile(
    r"\{\{[^{}\n]{1,60}\}\}|<%=?[^%\n]{1,60}%>|\[\[[^\[\]\n]{1,60}\]\]|@@\w{1,40}@@|%%[A-Za-z_]{1,40}%%|\$[A-Z][A-Z_]{1,40}\$|__[A-Z][A-Z_]{1,40}__|[$#]?\{[A-Za-z_][\w.]{1,40}\}"
    rf"|<<(?:{_WORDS})>>|\[(?:{_WORDS})\]|<(?:{_WORDS})>|\((?:{_WORDS}) ?(?:…|\.\.\.)\)|\*(?:{_WORDS})\* ?_{{3,}}|todo: ?(?:{_WORDS})",
    re.I,
)
_MAY_SLOT = re.compile(r"[{<\[@%(*]|\$[A-Z]|__|todo", re.I)
_HEAD = re.compile(r"^\s*(?:#+\s+|[-*+>]\s+|\d+[.)]\s+)*")
_LABEL = re.compile(r"(?:\*\*)?[^\W\d_][\w' -]{0,24}(?:\*\*)?\s?:(?:\*\*)?\s*$")
_TAG = re.compile(r"<[^<>]*>")
_END = re.compile(r"(?<=[.!?;…])\s+")
_FILLER = re.compile(r"(?:(?:" + "|".join(FILLER) + r")[\s.,;!…]*)+", re.I)
_KEYS = re.compile(r"(?:(?:" + "|".join(sorted(KEYS, key=len, reverse=True)) + r")[\s.,;!…]*){4,}", re.I)
_LATIN = re.compile(r"(?:" + "|".join(SYLLABLES) + r")+")
#: What may be called missing, with a determiner before it and a word or two about it behind.
_WHAT = rf"(?:{DETERMINERS} ?)?(?:(?:requested|gesuchte|demandée?|pedid[oa]|solicitad[oa]) )?{THINGS}(?: (?:you (?:asked for|requested|are looking for|were looking for)|demandée?|pedid[oa]|solicitad[oa]))?"
_CLAUSE = "|".join(
    [rf"(?:{_WHAT} )?(?:{'|'.join(GONE)})", rf"(?:{'|'.join(NONE_SUCH)}) (?:{_WHAT}|(?:{DETERMINERS} )?{THINGS})(?: à cette adresse| here| at this address)?", rf"(?:{_WHAT} )?(?:{'|'.join(DENIED)})", rf"(?:{_WHAT} )?(?:{'|'.join(BROKEN)})", rf"(?:{'|'.join(BUSY)})", rf"(?:{'|'.join(RETRY)})"]
)
#: Where it went wrong, or whose page it is.
_TAIL = r"(?: while (?:rendering|loading)| on our (?:side|end)| de notre côté| por nuestra parte| do nosso lado| bei uns| right now| at the moment)?(?:\s+[|–-]\s+(?-i:[A-Z])[\w.]*(?: \w+){0,2})?"
_ERROR = re.compile(rf"(?:(?:http )?(?:error |erreur |fehler |erro )?[45]\d\d\s*[–:|-]?\s*)?(?:{OPENERS})?(?:{_CLAUSE}){_TAIL}(?:\s*\([45]\d\d\))?", re.I)
_CODE = re.compile(r"(?:http )?(?:error|erreur|fehler|erro)? ?[45]\d\d(?:(?:\s*[–:-]\s*|\s+)(?-i:[A-ZÀ-Þ])[^\d.]{2,50})?|[^\W\d][^\d.,;:()]{2,50} \([45]\d\d\)", re.I)
_SCRIPTS = re.compile("|".join(f"(?:{x})" for x in SCRIPTS), re.I)


def evidence(line: str) -> str | None:
    """The kind of residue that stands in a line in place of content: template, filler, error, scripts; else None.

    Residue stands by itself: at the head of a line (behind heading or list marks, or a label with a colon) or as a
    sentence of its own. The same strings inside a sentence or between backticks or quotes are the author's own words.
    """
    if "`" not in line or line.count("`") % 2:
        clean = line
    else:
        clean = re.sub(r"`[^`]*`", " ` ", line)
    body = clean[_HEAD.match(clean).end() :].strip()
    if not body:
        return None
    for m in _SLOT.finditer(body) if _MAY_SLOT.search(body) else ():
        text = m.group()
        if text[0] in "$_" and text[:2] != "${" and text.upper() != text:
            continue
        before = body[: m.start()].rstrip()
        alone = not before or before[-1] in ".!?;…" or bool(_LABEL.fullmatch(before))
        if alone:
            after = body[m.end() :].lstrip(" _")
            if not after or not before or not after[0].islower():
                return "template"
    plain = _TAG.sub("\n", body)
    if "noscript" in body[:12].lower():
        return "scripts"
    for piece in plain.split("\n"):
        for sentence in [piece, *_END.split(piece)]:
            s = sentence.strip()
            core = s.rstrip(".!?;… ")
            if not core:
                continue
            if _FILLER.fullmatch(s) or _KEYS.fullmatch(s):
                return "filler"
            if _ERROR.fullmatch(core) or _CODE.fullmatch(core):
                return "error"
            if len(s) < 160 and _SCRIPTS.match(s):
                return "scripts"
    words = re.findall(r"[^\W\d_]+", plain.lower())
    if len(words) >= 4:
        if sum(w in _LOREM_SET for w in words) >= 0.8 * len(words) or all(_LATIN.fullmatch(w) for w in words):
            return "filler"
        if len(words) >= 12 and len(set(words)) * 4 <= len(words):
            return "filler"
    return None


_LOREM_SET = frozenset(LOREM)


def normal(line: str) -> str:
    """A line without marks, case, digits and runs of white space, for counting."""
    return re.sub(r"\s+", " ", re.sub(r"\d+", "0", line.lower())).strip(" #*->_")


def text_lines(text: str | None, kinds, starts) -> list[str]:
    """The non-empty lines of the text cells. Offsets count characters; a text without cells has one text cell: itself."""
    if not text:
        return []
    if kinds is None or starts is None or not len(kinds):
        cells = [text]
    else:
        ends = [*starts[1:], len(text)]
        cells = [text[a:b] for k, a, b in zip(kinds, starts, ends) if k == "text" and a is not None]
    return [s for c in cells for s in (x.strip() for x in re.split(r"[\r\n]+", c)) if s]


def marked_lines(documents: DataFrame, host: str) -> DataFrame:
    """``doc_id, text, host, line, kind, lines``: the different normalised lines of the text cells of every document, hashed.

    ``kind`` is the residue a line shows, or NULL; ``text`` tells copies of one text; ``lines`` is the number of different
    lines. Whole texts are read once, in Arrow batches; what leaves is a few numbers a line.
    """
    d = only(documents, "doc_id", "text", "cell_kinds", "cell_starts", host).toDF("doc_id", "text", "kinds", "starts", "host")
    d = d.select("doc_id", F.coalesce(F.col("host").cast("string"), F.lit("")).alias("host"), "text", "kinds", "starts", F.xxhash64("text").alias("same"))

    def run(batches):
        for b in batches:
            ids, hosts, lines, kinds, same, many = [], [], [], [], [], []
            starts = b.column("starts").to_pylist()
            cell_kinds = b.column("kinds").to_pylist()
            for i, text in enumerate(b.column("text")):
                seen = {}
                for line in text_lines(text.as_py(), cell_kinds[i], starts[i]):
                    key = normal(line)
                    if key not in seen or seen[key] is None:
                        seen[key] = evidence(line)
                if seen:
                    n = len(seen)
                    ids += [b.column("doc_id")[i].as_py()] * n
                    hosts += [b.column("host")[i].as_py()] * n
                    same += [b.column("same")[i].as_py()] * n
                    many += [n] * n
                    lines += seen
                    kinds += seen.values()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(same, pa.int64()), pa.array(hosts, pa.string()), pa.array(lines, pa.string()), pa.array(kinds, pa.string()), pa.array(many, pa.int32())], names=["doc_id", "text", "host", "line", "kind", "lines"])

    out = d.mapInArrow(run, "doc_id long, text long, host string, line string, kind string, lines int")
    return cut(out.select("doc_id", "text", F.xxhash64("host").alias("host"), F.xxhash64("line").alias("line"), "kind", "lines"))


def surely(hits: Column, of: Column, deviations: float = 3.0) -> Column:
    """The least share that ``hits`` out of ``of`` speak for: the lower bound of Wilson's interval."""
    z = deviations * deviations
    p = hits / of
    return (p + z / (2 * of) - deviations * F.sqrt((p * (1 - p) + z / (4 * of)) / of)) / (1 + z / of)


def residue(documents: DataFrame, host: str = "repo", share: float = 0.5) -> DataFrame:
    """``doc_id, kinds array<string>, lines bigint``: the documents with residue in place of content.

    Lines are counted by host over all documents, copies of one text once. A line that is surely (``surely``) on more
    than ``share`` of a host's texts is the host's boilerplate, a frame or footer around every page, and is subtracted. A
    document whose residual shows evidence is a case; so is one of which nothing but boilerplate with evidence is left, as
    it has no content. Documents without a host count as of one host. Empty and NULL texts, and those with no text cell,
    are not cases. NULL ids are left out; rows of one id count together.
    """
    lines = marked_lines(documents.where(F.col("doc_id").isNotNull()), host)
    # Only lines that show evidence somewhere need counting; the sizes of hosts come from all.
    sizes = lines.groupBy("host", "text").agg(F.first("doc_id").alias("d")).groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    shown = lines.where(F.col("kind").isNotNull())
    counts = shown.groupBy("host", "line", "text").agg(F.max("kind").alias("kind")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    boiler = counts.join(sizes, "host").where(surely(F.col("n"), F.col("docs")) > share).select("host", "line", F.lit(True).alias("frame"))
    by = shown.join(boiler, ["host", "line"], "left").groupBy("doc_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("frame").isNull(), F.col("kind")))).alias("own"), F.array_sort(F.collect_set("kind")).alias("every"),
        F.count_if(F.col("frame").isNull()).alias("lines"), F.count(F.lit(1)).alias("marked"), F.max("lines").alias("all_lines"),
    )
    bare = F.col("marked") == F.col("all_lines")
    return by.where((F.size("own") > 0) | bare).select("doc_id", F.when(F.size("own") > 0, F.col("own")).otherwise(F.col("every")).alias("kinds"), F.when(F.size("own") > 0, F.col("lines")).otherwise(F.col("marked")).alias("lines"))


def without_residue(documents: DataFrame, host: str = "repo") -> DataFrame:
    """The documents without residue, with all their columns."""
    bad = residue(documents, host).select(F.col("doc_id").alias("_bad"))
    return documents.join(bad, F.col("doc_id") == F.col("_bad"), "left_anti")
