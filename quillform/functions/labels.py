"""Labels, ids and what can be read from them; each is a Column expression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, casefold, context_text, detection_slug, fold, semantic_slug, text
from .types import suggest

#: Patterns of visual masks (``operators/detect.py`` names them in its list), boxes, instructions and prompts.
X_MASK = r"(?<![A-Za-z0-9])(?:\(\d{2}\)\s*)?[Xx]{4,}(?:\s*[@./()\-]\s*[Xx]{2,})*(?![A-Za-z0-9])"
UNDERSCORE_MASK = r"(?<![A-Za-z0-9])_{2,}(?:\s*[/.:\-]\s*_{2,})*(?![A-Za-z0-9])"
PHONE_MASK = r"(?<!\d)\(\s*0{2}\s*\)\s*0{4,5}\s*-\s*0{4}(?!\d)"
CPF_MASK = r"(?<!\d)0{3}\s*\.\s*0{3}\s*\.\s*0{3}\s*-\s*0{2}(?!\d)"
CURRENCY_MASK = r"(?i)(?<![A-Za-z0-9])R\$\s*(?:[Xx]{2,}(?:\s*[.,]\s*[Xx]{2,3}){0,3}|0{2,}(?:\s*[.,]\s*0{2,3}){0,3}|_{2,}(?:\s*[.,]\s*_{2,3}){0,3})(?![A-Za-z0-9])"
EMAIL_MASK = r"(?i)(?<![A-Za-z0-9._%+\-])(?:contato|email|e-mail|exemplo|teste|usuario|usu[aá]rio|user|x{4,})@(?:empresa|exemplo|example|dominio|dom[ií]nio|x{4,})(?:\.[A-Za-zx]{2,}){1,3}(?![A-Za-z0-9._%+\-])"
BRACE_MASK = r"(?U)(?<!\{)\{([^\W\d_][\w.-]{0,95})\}(?!\})"
DATE_MASK = r"_{2,}\s*/\s*_{2,}\s*/\s*_{2,}"
BOX = r"☐|□|☑|☒|\(\s*\)"
TAG = r"\{\{([^{}]+)\}\}"
ALTERNATIVE = r"(?i)^\s*OU\s*$"
INSTRUCTION = r"(?i)^\s*(?:informar|informe|descrever|descreva|detalhar|detalhe|indicar|indique|justificar|justifique|preencher|preencha)\b"
PROMPT = r"(?i)(?:escolher|selecione|selecionar)\s+(?:um|uma)\s+(?:item|op[cç][aã]o)\.?\s*$"
WHOLE_PROMPT = r"(?i)^\s*(?:escolher|selecione|selecionar)\s+(?:um|uma)\s+(?:item|op[cç][aã]o)\.?\s*$"
FOLLOW_UP = r"(?i)^\s*(?:observa[cç][aã]o(?:\s*/\s*justificativa)?|justificativa|complemento|detalhamento|informa[cç][oõ]es? complementares?)\b"
#: What every place to fill in, tag, box or prompt holds: texts without it need no other pattern.
FILL_SIGN = r"[{_(@$☐□☑☒]|[Xx]{4}|000|(?i:escolher|selecion)"
SECTION_NUMBER = r"^\s*\d+(?:\.\d+)*\.?\s*"
LABEL_TAIL = r"([^:;|]{2,120})\s*[:：]\s*$"
#: Fill areas and numbered titles as the layer that labels records sees them.
FILL = r"(?i)^(?:_+|X{4,}|x{4,}|R\$\s*_+|\(?\s*\d{0,2}\s*\)?\s*[_0Xx.-]+|(?:escolher|selecione|selecionar)\s+(?:um|uma)\s+(?:item|op[cç][aã]o)\.?)$"
NUMBERED_TITLE = r"^\s*\d+(?:\.\d+)*[.)]?\s+\S"
#: Words of a page header, of which two make one.
PAGE_HEADER = ("secretaria de estado", "governo da paraíba", "governo da paraiba", "sistema integrado de gerenciamento", "cep:")
#: Long options and the short labels they get.
SHORT_CHOICES = (
    (("não se aplica", "nao se aplica"), "Não se aplica"),
    (("não ser superior", "nao ser superior", "provável valor"), "Valor abaixo do limite"),
    (("demandas supervenientes", "art. 13"), "Demanda superveniente"),
    (("emergencial", "calamidade pública", "calamidade publica"), "Emergência ou calamidade"),
    (("sigilos", "sigilosa", "sigilosas"), "Informações sigilosas"),
    (("verificado posteriormente", "setor administrativo"), "Análise administrativa posterior"),
)
#: Words in an id and the section that they suggest, in order; ids' first parts and profile prefixes.
SECTIONS = (
    (("company", "empresa", "supplier", "fornecedor", "vendor"), "Empresa / Fornecedor"),
    (("address", "endereco", "endereço", "cep", "city", "cidade", "state", "uf"), "Endereço"),
    (("process", "processo", "contract", "contrato", "procurement", "licitacao", "licitação"), "Processo / Contrato"),
    (("document", "documento", "date", "data", "number", "numero", "número"), "Documento"),
    (("signature", "assinatura", "signatory", "responsavel", "responsável"), "Assinaturas"),
)
OTHER_SECTION = "Dados do documento"
PROFILE_PREFIXES = {
    "company": "company", "empresa": "company", "supplier": "supplier", "fornecedor": "supplier", "vendor": "supplier", "address": "address", "endereco": "address", "endereço": "address",
    "signatory": "signatory", "responsavel": "signatory", "responsável": "signatory",
}
#: Labels that say nothing by themselves (normalised), and those too poor to trust.
GENERIC = ("campo", "field", "opcao", "valor", "data", "nome", "tipo", "responsavel", "descricao", "item", "sim", "nao", "n a", "conforme", "parcial")
POOR = ("item", "tipo", "campo", "descricao", "opcao")
#: Parts of a package and their names.
PARTS = (("document.xml", "Corpo / tabelas / caixas de texto"), ("footnotes.xml", "Notas de rodapé"), ("endnotes.xml", "Notas finais"), ("comments.xml", "Comentários"))
#: Ids whose labels are not made from them.
PLAIN_LABELS = {"valor": "Conteúdo", "value": "Conteúdo", "texto": "Conteúdo", "text": "Conteúdo", "campo": "Campo a preencher", "field": "Campo a preencher"}
#: Hints by type.
HINTS = {
    "date": "Formato exibido: dia/mês/ano.", "currency": "Digite os centavos normalmente. Exemplo: R$ 1.250,00", "integer": "Use somente números inteiros.", "decimal": "Use vírgula ou ponto para as casas decimais.",
    "percentage": "Informe uma porcentagem entre 0% e 100%.", "cnpj": "Formato esperado: 00.000.000/0000-00", "cpf": "Formato esperado: 000.000.000-00", "cep": "Formato esperado: 00000-000",
    "phone": "Informe DDD e número. Exemplo: (83) 99999-9999", "email": "Exemplo: nome@orgao.gov.br",
}
_EDGES = " :：–—-\t\r\n"


def _any(x: Column, needles: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(x, F.lit(n)) for n in needles])


def _whole(pattern: str) -> str:
    """A pattern for texts that are nothing else."""
    return f"(?i)^(?:{pattern[4:]})$" if pattern.startswith("(?i)") else f"^(?:{pattern})$"


def _upper_first(x: Column) -> Column:
    return F.concat(F.upper(F.left(x, F.lit(1))), F.substring(x, 2, 1 << 20))


def space(x: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text(x), r"(?U)\s+", " "))


def clean(x: Column) -> Column:
    """A label without section number and without colons and dashes at its ends."""
    return F.btrim(F.regexp_replace(space(x), SECTION_NUMBER, ""), F.lit(_EDGES))


def clean_context(x: Column) -> Column:
    """A label found beside a tag, or an empty text: 100 characters at most, no tag in it, and no sentence."""
    t = F.btrim(space(x), F.lit(" :：–—-"))
    bad = (F.char_length(t) > 100) | F.contains(t, F.lit("{{")) | F.contains(t, F.lit("}}")) | (F.regexp_count(t, F.lit(r"\.")) > 1) | t.rlike(r"[.;?!]$")
    return F.when(bad, "").otherwise(t)


def clean_choice(x: Column) -> Column:
    """A label of a native choice, or an empty text: 140 characters at most and no tag in it."""
    return bound(F.btrim(space(x), F.lit(_EDGES)), lambda t: F.when((F.char_length(t) > 140) | F.contains(t, F.lit("{{")) | F.contains(t, F.lit("}}")), "").otherwise(t))


def before_tag(x: Column) -> Column:
    """The label in the text before a tag: its last line, which must end in a colon or dash; bullets and numbers in front go."""
    line = space(F.element_at(F.split(text(x), r"[\n\r\t]", -1), -1))
    found = F.regexp_extract(line, r"^(.*?)\s*[:：–—-]\s*$", 1)
    return clean_context(F.regexp_replace(found, r"(?U)^[\s•·▪◦*\-–—\d.)]+", ""))


def reasonable(x: Column, most: int = 150) -> Column:
    """Whether a text can be a label: 2 to ``most`` characters, two letters, no tag, no separator of alternatives."""
    t = F.btrim(space(x), F.lit(" :：–—-"))
    return F.char_length(t).between(2, most) & ~t.rlike(TAG) & ~t.rlike(ALTERNATIVE) & (F.regexp_count(t, F.lit(r"\p{L}")) >= 2)


def is_section(x: Column) -> Column:
    """Whether a text reads like a section's title: a number in front or a colon behind, 190 characters at most."""
    t = space(x)
    return F.char_length(t).between(1, 190) & (t.rlike(r"^\d+(?:\.\d+)*\.?\s+") | t.endswith(":"))


def is_page_header(x: Column) -> Column:
    low = casefold(x)
    return reduce(lambda a, b: a + b, [F.contains(low, F.lit(t)).cast("int") for t in PAGE_HEADER]) >= 2


def is_fill(x: Column) -> Column:
    """Whether a text is nothing but a place to fill in: blank, one mask, a prompt, or begins with a box."""
    t = space(x)
    whole = [t.rlike(_whole(p)) for p in (X_MASK, UNDERSCORE_MASK, PHONE_MASK, CPF_MASK, CURRENCY_MASK, EMAIL_MASK)]
    return (t == "") | reduce(lambda a, b: a | b, whole) | t.rlike(WHOLE_PROMPT) | t.rlike(f"^(?:{BOX})")


def has_fill(x: Column) -> Column:
    """Whether a text has a place to fill in, a tag or a box anywhere, or is blank."""
    t = text(x)
    every = reduce(lambda a, b: a | b, [t.rlike(p) for p in (TAG, X_MASK, UNDERSCORE_MASK, PHONE_MASK, CPF_MASK, CURRENCY_MASK, EMAIL_MASK, WHOLE_PROMPT, BOX)])
    return t.rlike(r"(?U)^\s*$") | (t.rlike(FILL_SIGN) & every)


def local(x: Column) -> Column:
    """The label that ends a text with a colon, or all of it if it can be a label; else an empty text."""
    t = space(x)
    tail = F.regexp_extract(t, LABEL_TAIL, 1)
    rest = F.btrim(t, F.lit(" |;–—-"))
    return F.when(tail != "", clean(tail)).when(reasonable(rest), clean(rest)).otherwise("")


def instruction(x: Column) -> Column:
    """A label from an instruction: without its verb, 76 characters at most."""
    t = F.regexp_replace(space(x), r"(?i)^(?:informar|informe|descrever|descreva|detalhar|detalhe|indicar|indique|justificar|justifique|preencher|preencha)\s+", "")
    t = F.when(F.char_length(t) > 76, F.concat(F.rtrim(F.left(t, F.lit(73)), F.lit(" ,;:-")), F.lit("…"))).otherwise(t)
    return F.when(t == "", "Campo a preencher").otherwise(_upper_first(t))


def short_choice(x: Column) -> Column:
    """A short label for a long option: by its words, else its first sentence, cut at 85 characters."""
    t = clean(x)
    low = casefold(t)
    first = F.element_at(F.split(t, r"(?<=[.!?;])\s+", 2), 1)
    out = F.when(F.char_length(first) <= 88, first).otherwise(F.concat(F.rtrim(F.left(first, F.lit(85)), F.lit(" ,;:-")), F.lit("…")))
    for words, label in reversed(SHORT_CHOICES):
        out = F.when(_any(low, words), label).otherwise(out)
    return out


def humanize(x: Column) -> Column:
    """The last part of an id with blanks for its separators."""
    return _upper_first(F.translate(F.element_at(F.split(text(x), r"\."), -1), "_-", "  "))


def from_id(x: Column) -> Column:
    """A label made from an id; letters after anything but a letter are capitals."""
    raw = F.trim(text(x))
    words = F.regexp_extract_all(F.lower(F.translate(raw, "._-", "   ")), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    out = F.array_join(F.transform(words, _upper_first), "")
    for k, v in PLAIN_LABELS.items():
        out = F.when(F.lower(raw) == k, v).otherwise(out)
    return out


def field_id(x: Column) -> Column:
    """``auto.`` and a label's slug of 72 characters; a slug that begins with a digit gets a prefix, an empty one is ``campo``."""
    slug = detection_slug(x)
    slug = F.when(slug == "", "campo").otherwise(slug)
    return F.concat(F.lit("auto."), F.left(F.when(slug.rlike("^[0-9]"), F.concat(F.lit("campo_"), slug)).otherwise(slug), F.lit(72)))


def legacy_id(x: Column) -> Column:
    """An id for a token in single braces: dots and hyphens stay."""
    t = F.regexp_replace(F.regexp_replace(fold(x), r"[^a-z0-9_.-]+", "_"), "_+", "_")
    t = F.btrim(t, F.lit("._-"))
    t = F.when(t == "", "campo").when(~t.rlike("^[a-z]"), F.concat(F.lit("campo_"), t)).otherwise(t)
    return F.concat(F.lit("auto."), F.left(t, F.lit(72)))


def context_slug(x: Column) -> Column:
    whole = bound(F.replace(context_text(x), F.lit(" "), F.lit("_")), lambda t: F.when(t.rlike("^[0-9]"), F.concat(F.lit("campo_"), t)).otherwise(t))
    return F.rtrim(F.left(whole, F.lit(72)), F.lit("_"))


def _section_slug(x: Column) -> Column:
    return context_slug(F.regexp_replace(text(x), r"^\s*\d+(?:\.\d+)*[.)]?\s*", ""))


def profile_identity(label: Column, section: Column, kind: Column) -> Column:
    """``section.label:type``, without the section where there is none; empty without a label."""
    front = bound(_section_slug(section), lambda b: F.when(b != "", F.concat(b, F.lit("."))).otherwise(""))
    behind = bound(context_slug(kind), lambda t: F.when(t == "", "text").otherwise(t))
    return bound(context_slug(label), lambda a: F.when(a == "", "").otherwise(F.concat(front, a, F.lit(":"), behind)))


def context_ids(label: Column, section: Column, kind: Column, index: Column) -> Column:
    """The ids that a field can have, by preference: a general label takes its section in front first."""
    number = F.lpad(F.greatest(F.lit(1), index).cast("string"), 2, "0")
    none = bound(context_slug(kind), lambda t: F.concat(F.lit("auto_word."), F.when(t == "", "campo").otherwise(t), F.lit("_"), number))

    def ids(v: Column) -> Column:
        a, b = v["a"], v["b"]
        both = F.concat(b, F.lit("."), a)
        return F.when(a == "", F.array(none)).when(b == "", F.array(a)).when(context_text(label).isin(*GENERIC), F.array(both, a)).otherwise(F.array(a, both))

    return bound(F.struct(context_slug(label).alias("a"), _section_slug(section).alias("b")), ids)


def suggest_section(field_id_: Column) -> Column:
    low, out = casefold(field_id_), F.lit(OTHER_SECTION)
    for words, section in reversed(SECTIONS):
        out = F.when(_any(low, words), section).otherwise(out)
    return out


def suggest_profile_key(field_id_: Column) -> Column:
    """The id with a profile's prefix in place of its first part; empty for others."""
    parts = F.filter(F.split(text(field_id_), r"[._-]+"), lambda p: p != "")
    prefix = F.create_map(*[F.lit(v) for kv in PROFILE_PREFIXES.items() for v in kv])[F.lower(F.get(parts, F.lit(0)))]
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.when(prefix.isNotNull(), F.array_join(F.concat(F.array(prefix), rest), ".")).otherwise("")


def part_name(x: Column) -> Column:
    name = F.element_at(F.split(text(x), "/"), -1)
    out = F.when(F.startswith(name, F.lit("header")), "Cabeçalho").when(F.startswith(name, F.lit("footer")), "Rodapé").otherwise(name)
    for part, said in PARTS:
        out = F.when(name == part, said).otherwise(out)
    return out


def process_number(answers: Column) -> Column:
    """The process number among answers (MAP): by preferred keys, else the first key that names a process and a number."""
    out = F.lit(None).cast("string")
    for key in ("processo", "processo.numero", "process_number", "process.number"):
        out = F.when(F.coalesce(answers[key], F.lit("")) != "", answers[key]).otherwise(out)
    named = F.filter(F.map_entries(answers), lambda e: F.lower(e["key"]).rlike("process") & F.lower(e["key"]).rlike("number|numero"))
    return F.coalesce(out, F.get(named, F.lit(0))["value"], F.lit(""))


def is_assisted(source: Column, auto_tagged: Column, id_source: Column, field_id_: Column) -> Column:
    low = lambda x: F.lower(F.trim(text(x)))
    return (low(source) == "automatic") | F.coalesce(auto_tagged, F.lit(False)) | (low(id_source) == "context_resolver") | F.startswith(low(field_id_), F.lit("auto."))


def hint(custom: Column, kind: Column, minimum: Column) -> Column:
    """A field's own hint, else one for its table or type."""
    own = F.trim(text(custom))
    rows = F.greatest(F.lit(0), F.coalesce(minimum, F.lit(1)))
    table = F.when(rows > 0, F.concat(F.lit("Adicione pelo menos "), rows.cast("string"), F.lit(" item(ns). É possível colar linhas copiadas do Excel."))).otherwise("Adicione, duplique, remova ou cole linhas conforme necessário.")
    known = F.coalesce(F.create_map(*[F.lit(v) for kv in HINTS.items() for v in kv])[kind], F.lit(""))
    return F.when(own != "", own).when(kind == "repeatable_table", table).otherwise(known)


def supports_options(kind: Column) -> Column:
    return F.lower(F.trim(text(kind))) == "dropdown"


def layout_int(x: Column, default: Column) -> Column:
    """A whole number, or the default where it isn't one; fractions of numbers are cut."""
    return F.coalesce(F.trim(x.cast("string")).try_cast("int"), default)


def column_label_key(x: Column) -> Column:
    return F.trim(F.regexp_replace(casefold(x), "[^a-z0-9áàâãéêíóôõúç]+", " "))


def mask_type(preview: Column, label: Column) -> Column:
    """The type of a filled-in mask, else what its label suggests."""
    t = space(preview)
    slug = detection_slug(label)
    only = lambda p: t.rlike(_whole(p))
    short = F.contains(slug, F.lit("observacao_curta")) | (slug.endswith("_observacao") & t.rlike("^_{2,20}$"))
    typed = F.when(only(DATE_MASK), "date").when(only(PHONE_MASK), "phone").when(only(CPF_MASK), "cpf").when(only(CURRENCY_MASK), "currency").when(only(EMAIL_MASK), "email")
    return F.when(short, "text").otherwise(F.coalesce(typed, suggest(label)))


def column_type(header: Column, samples: Column) -> Column:
    """A table column's type: that of the first sample with a mask, else what its header suggests."""
    only = lambda x, p: space(x).rlike(_whole(p))
    typed = lambda x: F.when(only(x, DATE_MASK), "date").when(only(x, PHONE_MASK), "phone").when(only(x, CPF_MASK), "cpf").when(only(x, CURRENCY_MASK), "currency").when(only(x, EMAIL_MASK), "email")
    return F.coalesce(F.get(F.filter(F.transform(samples, typed), lambda x: x.isNotNull()), F.lit(0)), suggest(header))


def is_poor(x: Column) -> Column:
    t = space(x)
    return (t == "") | t.rlike(r"(?i)^(?:campo|field)\s*\d+$") | (semantic_slug(t).isin(*POOR) & ~F.contains(t, F.lit(" ")))


def equivalent(a: Column, b: Column) -> Column:
    """Whether two labels say the same: one's slug holds the other's."""
    x, y = semantic_slug(a), semantic_slug(b)
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))


def supports_type(kind: Column, label: Column, preview: Column) -> Column:
    """Whether a label or what stands in a field speaks for its type."""
    slug, p = semantic_slug(label), text(preview)
    both = casefold(F.concat(text(label), F.lit(" "), p))
    has = lambda *xs: _any(slug, xs)
    return (
        F.when(kind == "date", has("data") | p.rlike(r"_+\s*/\s*_+\s*/\s*_+")).when(kind == "phone", has("telefone", "celular", "fone") | F.contains(p, F.lit("("))).when(kind == "email", has("email", "e_mail") | F.contains(p, F.lit("@")))
        .when(kind == "cpf", has("cpf")).when(kind == "cnpj", has("cnpj")).when(kind == "cep", has("cep")).when(kind.isin("dropdown", "checkbox", "checkbox_group"), _any(both, ("sim", "não", "nao", "escolher", "selecione", "☐", "□"))).otherwise(True)
    )


def tag_for(kind: Column, field_id_: Column, options: Column, choice: Column) -> Column:
    """The tag that an accepted field gets; null where it cannot have one: no id, or fewer than two options, or an option that is blank or closes tags.

    ``options`` is ARRAY<STRUCT<label, value>>.
    """
    safe = lambda x: F.replace(space(x), F.lit("|"), F.lit(" / "))
    said = F.transform(options, lambda o: F.when(safe(o["label"]) == safe(o["value"]), safe(o["value"])).otherwise(F.concat(safe(o["label"]), F.lit(" => "), safe(o["value"]))))
    good = (F.size(options) >= 2) & F.forall(options, lambda o: (space(o["label"]) != "") & (space(o["value"]) != "") & ~F.contains(o["label"], F.lit("}}")) & ~F.contains(o["value"], F.lit("}}")))
    listed = F.when(good, F.concat(F.lit("{{"), F.when(choice, "single_choice").otherwise("dropdown"), F.lit(":"), field_id_, F.lit("|"), F.array_join(said, "|"), F.lit("}}")))
    plain = F.concat(F.lit("{{"), F.when(kind.isin("date", "checkbox"), F.concat(kind, F.lit(":"))).otherwise(""), field_id_, F.lit("}}"))
    return F.when(F.trim(text(field_id_)) == "", None).when(kind == "dropdown", listed).otherwise(plain)
