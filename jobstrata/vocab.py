"""Fixed values of the postings domain.

Everything in this module is a fixed value: labels, word lists and patterns that
decide which rows match.  They are data, kept apart from the code, and every
operator takes them as a parameter so another language or domain can plug in.
"""

# --- category labels, fallback label last ------------------------------------
FALLBACK_CATEGORY = "Outros"

CATEGORY_LABELS = [
    "IT", "Saúde", "Restauração & Hotelaria", "Vendas & Comercial",
    "Logística & Armazém", "Construção & Obras", "Engenharia",
    "Finanças & Contab.", "Educação & Formação", "Administrativo",
    "Beleza & Estética", "Segurança", "Marketing & Comunicação",
    "Recursos Humanos", "Jurídico & Legal", "Design & Criativo",
    "Imobiliário", FALLBACK_CATEGORY,
]

# --- labels that are folded into another label --------------------------------
CATEGORY_ALIASES = {
    "Hotelaria": "Restauração & Hotelaria",
    "Hospitalidade & Turismo": "Restauração & Hotelaria",
    "Turismo": "Restauração & Hotelaria",
    "Banca": "Finanças & Contab.",
    "Bancos & Finanças": "Finanças & Contab.",
    "Administração": "Administrativo",
    "Liderança": "Administrativo",
    "Project Manager": "Administrativo",
    "Comunicação": "Marketing & Comunicação",
    "Audiovisual & Multimédia": "Marketing & Comunicação",
    "Formação": "Educação & Formação",
    "Investigação": "Educação & Formação",
    "Recrutamento": "Recursos Humanos",
    "Ambiente": "Agricultura & Ambiente",
    "Farmacêutica": "Saúde",
    "Estágio": FALLBACK_CATEGORY,
    "Relações Internacionais": FALLBACK_CATEGORY,
    "Artes & Artesanato": FALLBACK_CATEGORY,
}

# --- title → category patterns, first match wins -------------------------------
CATEGORY_RULES = [
    ("IT",
     r"\b(programador|developer|devops|sysadmin|sql|java|python|\.net|php|"
     r"javascript|typescript|react|angular|vue|node\.?js|software|infra|"
     r"redes|network|cloud|data.?base|machine.learning|deep.learning|"
     r"ia\b|ai\b|backend|frontend|fullstack|scrum|agile|qa\b|tester|"
     r"it\s|tech\b|noc\b|ciberseguran[cç]a|cybersecurity|erp|sap|"
     r"salesforce|outsystems|liferay|sharepoint|wordpress|linux|"
     r"windows.server|suporte.inform[aá]tico|helpdesk|sistemas|"
     r"analista.de.sistemas|arquiteto.de.software|ux\b|ui\b)\b"),
    ("Saúde",
     r"\b(enfermeir[oa]|m[eé]dic[oa]|farmac[eê]utic[oa]|"
     r"t[eé]cnico.de.sa[uú]de|auxiliar.de.sa[uú]de|fisioterapeuta|"
     r"nutricionista|psic[oó]log[oa]|cuidador|cuidados.continuados|"
     r"cl[ií]nica|hospital|optometrista|terapeuta|ortoptista|"
     r"radiologista|imagiologia|laborat[oó]rio.cl[ií]nico)\b"),
    ("Restauração & Hotelaria",
     r"\b(empregad[oa].de.mesa|cozinheir[oa]|chef|barista|barman|"
     r"bartender|hotel|hotelaria|rececionista|recepcionista|restaurante|"
     r"restaura[cç][aã]o|turismo|housekeeping|f&b|food.and.beverage)\b"),
    ("Vendas & Comercial",
     r"\b(comercial|vendas|sales\b|account.manager|key.account|"
     r"gestor.de.conta|representante.comercial|promotor|loja|retalho|"
     r"call.center|telemarketing|business.development|distribuidor)\b"),
    ("Marketing & Comunicação",
     r"\b(marketing|comunica[cç][aã]o|social.media|community.manager|"
     r"seo\b|sem\b|copywriter|content.manager|conte[uú]do|"
     r"rela[cç][oõ]es.p[uú]blicas|\brp\b|publicidade|branding|"
     r"growth.hacker|digital.marketing|e.?mail.marketing|newsletter|"
     r"campanhas|media.buyer)\b"),
    ("Recursos Humanos",
     r"\b(recursos.humanos|\brh\b|\bhr\b|recrutamento|recruiter|"
     r"talent.acquisition|people.manager|hrbp|gest[aã]o.de.pessoas|"
     r"payroll|processamento.salarial|forma[cç][aã]o.e.desenvolvimento|"
     r"\bl&d\b|onboarding|employer.branding)\b"),
    ("Jurídico & Legal",
     r"\b(advogad[oa]|jurista|legal\b|jur[ií]dic[oa]|solicitador|"
     r"not[aá]rio|compliance|gdpr|rgpd|direito|contencioso|paralegal|"
     r"assessor.jur[ií]dico)\b"),
    ("Design & Criativo",
     r"\b(designer|design.gr[aá]fico|motion.designer|illustrator|"
     r"photoshop|figma|sketch|adobe|criativ[oa]|art.director|"
     r"diretor.de.arte|produ[cç][aã]o.audiovisual|fot[oó]grafo|"
     r"anima[cç][aã]o|3d.artist|arquiteto.de.interiores)\b"),
    ("Imobiliário",
     r"\b(imobili[aá]ri[oa]|mediador.imobili[aá]rio|"
     r"consultor.imobili[aá]rio|angariador|arrendamento|"
     r"gest[aã]o.de.condom[ií]nio|property.manager|real.estate)\b"),
    ("Logística & Armazém",
     r"\b(log[ií]stica|armaz[eé]m|operador.de.armaz[eé]m|empilhador|"
     r"distribui[cç][aã]o|motorista|entregas|expedi[cç][aã]o|"
     r"supply.chain|procurement|compras)\b"),
    ("Construção & Obras",
     r"\b(constru[cç][aã]o|obras|pedreiro|serralheir[oa]|canalizador|"
     r"eletricista|electricista|carpinteir[oa]|pintor|trolha|"
     r"top[oó]grafo|medidor.or[cç]amentista)\b"),
    ("Engenharia",
     r"\b(engenheir[oa]|engineering|mec[aâ]nic[oa]|electrot[eé]cnic[oa]|"
     r"eletrot[eé]cnic[oa]|civil\b|industrial\b|qualidade|processos|"
     r"manuten[cç][aã]o.industrial|instrumenta[cç][aã]o|automa[cç][aã]o)\b"),
    ("Finanças & Contab.",
     r"\b(contabilist[ao]|contabilidade|financeir[ao]|finan[cç]as|"
     r"tesouraria|auditor|fiscal\b|controller|controlling|\bcfo\b|"
     r"fundo\b|investimento|banco|banca|seguros|actuar)\b"),
    ("Educação & Formação",
     r"\b(professor|formador|formadora|educa[cç][aã]o|forma[cç][aã]o|"
     r"explicador|instrutor|coordenador.pedag[oó]gico|"
     r"diretor.de.escola|docente)\b"),
    ("Administrativo",
     r"\b(administrativ[oa]|secret[aá]ri[ao]|assistente.administrativo|"
     r"rece[cç][aã]o|backoffice|front.?office|apoio.ao.cliente|"
     r"atendimento|fatura[cç][aã]o)\b"),
    ("Beleza & Estética",
     r"\b(cabeleireir[oa]|esteticista|manicure|t[eé]cnico.de.est[eé]tica|"
     r"\bspa\b|estetica|beauty|depila[cç][aã]o|tatuador)\b"),
    ("Segurança",
     r"\b(vigilante|seguran[cç]a\b|security.guard|porteiro|rondista|"
     r"guarda.noturno)\b"),
]

# --- title → seniority patterns, first match wins ------------------------------
SENIORITY_RULES = [
    ("director", r"\b(diretor|diretora|director|directora|head of|chief|cto|cfo|ceo|coo)\b"),
    ("manager", r"\b(manager|gestor|gestora|gerente|coordenador|coordenadora|"
                r"respons[aá]vel|supervisor|supervisora)\b"),
    ("lead", r"\b(lead|l[ií]der|team leader|tech lead|scrum master)\b"),
    ("senior", r"\b(senior|s[eé]nior|sr\.?\s|pleno)\b"),
    ("junior", r"\b(junior|j[uú]nior|jr\.?\s|est[aá]gio|trainee|internship|"
               r"entry.level|rec[eé]m.licenciado)\b"),
]
SENIORITY_DEFAULT = "mid"
SENIORITY_MISSING = "na"
SENIOR_PLUS = ["senior", "manager", "director", "lead"]

# --- boolean flag patterns -------------------------------------------------------
FLAG_PATTERNS = {
    "gender_marker": r"\([MmFf]/[MmFf]\)",
    "is_internship": r"\b(?:est[aá]gio|trainee|internship|estagi[aá]ri[oa]|est[aá]gios)\b",
    "remote_hint": r"\b(?:remoto|remote|teletrabalho|teletrabalhador|work.from.home|wfh)\b",
    "part_time_hint": r"\b(?:part.time|part time|meio.tempo|parcial|tempo parcial|horas?\s+semanais)\b",
}

# --- titles that are site navigation, compared after folding ----------------------
NAVIGATION_TITLES = [
    "pesquisa avancada", "mapa do site", "pagina inicial", "todos os anuncios",
    "my portal", "termos de uso", "politica de privacidade", "faq", "sitemap",
    "sobre nos", "emprego e carreiras", "bolsa de emprego", "ofertas de emprego",
    "ver mais ofertas", "ver todas as ofertas", "login", "registo",
]
PLATFORM_SUFFIX = r"\s*[\-|]\s*mobijake\b.*$"

# --- place names -------------------------------------------------------------------
GAZETTEER = [
    "Lisboa", "Porto", "Braga", "Coimbra", "Setúbal", "Aveiro", "Faro",
    "Leiria", "Santarém", "Viseu", "Évora", "Guarda", "Bragança",
    "Castelo Branco", "Portalegre", "Viana do Castelo", "Vila Real", "Beja",
    "Funchal", "Ponta Delgada", "Sintra", "Cascais", "Almada", "Amadora",
    "Loures", "Odivelas", "Matosinhos", "Gaia",
]
PLACE_PREPOSITIONS = "para|em|na|no|zona de|area de|regiao de"

# --- folded texts that are not a place / not a company ------------------------------
PLACE_BLOCKLIST = [
    "part time", "part-time", "m/f", "f/m", "full time", "fulltime",
    "urgente", "imediato", "varios", "varias", "disponiveis", "disponivel",
    "oportunidade", "excelente", "horario", "turnos", "noturno", "remoto",
    "teletrabalho", "junior", "senior", "lead", "head",
    "the netherlands", "netherlands", "espana", "france", "uk", "london",
    "luxemburgo", "angola", "mocambique", "brasil", "suica", "alemanha",
    "holanda", "belgica",
]
COMPANY_BLOCKLIST = PLACE_BLOCKLIST + [
    "gestao", "comercial", "tecnico", "tecnica", "assistente",
    "consultor", "consultora", "engenheiro", "engenheira", "portugal",
    "portugues", "iberia", "iberica", "europa", "nacional", "internacional",
    "grupo", "empresa", "entidade", "organizacao", "cliente", "clientes",
    "projecto", "projeto", "area", "zona", "sector", "setor",
]

# --- lower-cased place names found in the company column -----------------------------
PLACE_NAMES_AS_COMPANY = [
    "lisbon", "lisboa", "porto", "braga", "maia", "algarve", "faro", "coimbra",
    "aveiro", "setubal", "leiria", "evora", "beja", "portalegre", "castelo branco",
    "viana do castelo", "braganca", "guarda", "viseu", "santarem", "funchal",
    "ponta delgada", "angra do heroismo", "horta", "almada", "amadora", "sintra",
    "cascais", "loures", "oeiras", "vila nova de gaia", "matosinhos", "gondomar",
    "portugal", "nationwide", "nacional", "remote", "remoto",
]

# --- tokens dropped from keyword counts -------------------------------------------------
STOPWORDS = [
    "a", "ao", "aos", "as", "com", "da", "das", "de", "do", "dos", "e", "em", "m", "f",
    "mf", "m/f", "na", "nas", "no", "nos", "o", "os", "ou", "para", "por", "se", "um",
    "uma", "the", "of", "and", "to", "in", "for", "with", "job", "vaga", "procura",
    "precisa", "precisa-se", "admite", "recruta", "lisboa", "porto", "braga",
    "que", "mais", "mas", "seu", "sua", "isso", "este", "esta",
]

# --- words that mark a sampled posting as technical --------------------------------------
TECH_WORDS = [
    "programador", "developer", "engineer", "designer", "data", "analyst",
    "architect", "cloud", "cybersecurity", "product", "ai", "prompt", "software",
    "frontend", "backend", "fullstack", "remote", "tech",
]

# --- labelled year ranges ------------------------------------------------------------------
PERIODS = [
    ("pre_crisis_baseline_2008_2011", "Crisis Baseline", 2008, 2011),
    ("austerity_recovery_2012_2015", "Austerity / Recovery", 2012, 2015),
    ("tech_boom_2016_2019", "Tech Boom", 2016, 2019),
    ("pandemic_shock_2020_2021", "Pandemic Shock", 2020, 2021),
    ("post_pandemic_2022_2024", "Post-Pandemic", 2022, 2024),
]

# --- open-ended buckets of the sampling endpoint: last year → key ------------------------
SAMPLE_BUCKETS = [
    (2011, "2008_2011"), (2015, "2012_2015"), (2019, "2016_2019"), (2021, "2020_2021"),
    (None, "2022_2024"),
]

# --- repair of titles that already lost bytes: ordered (pattern, replacement) ----------------
LOST_BYTE_REPAIRS = [
    ("\ufffdES", "ÇÕES"), ("\ufffdO(?![A-Za-z0-9_])", "ÇÃO"), ("VEL(?![A-Za-z0-9_])", "ÁVEL"),
    ("TCNICO", "TÉCNICO"), ("MDICO", "MÉDICO"), ("SADE", "SAÚDE"),
    ("COMRCIO", "COMÉRCIO"), ("MECNICO", "MECÂNICO"), ("GESTO", "GESTÃO"),
    ("CONSTRUO", "CONSTRUÇÃO"), ("INFORMAO", "INFORMAÇÃO"), ("DIREO", "DIREÇÃO"),
    ("PRODUO", "PRODUÇÃO"), ("\ufffd", ""),
]

# --- byte pairs of UTF-8 letters read as a Windows code page, and the letters (fixed values) --------
BYTE_PAIRS = [
    ("Ã¡", "á"), ("Ã ", "à"), ("Ã£", "ã"), ("Ã¢", "â"), ("Ã¤", "ä"), ("Ã©", "é"), ("Ã¨", "è"), ("Ãª", "ê"), ("Ã«", "ë"),
    ("Ã\u00ad", "í"), ("Ã¬", "ì"), ("Ã®", "î"), ("Ã¯", "ï"), ("Ã³", "ó"), ("Ã²", "ò"), ("Ãµ", "õ"), ("Ã´", "ô"), ("Ã¶", "ö"),
    ("Ãº", "ú"), ("Ã¹", "ù"), ("Ã»", "û"), ("Ã¼", "ü"), ("Ã§", "ç"), ("Ã‡", "Ç"), ("ÃÁ", "Á"), ("Ã‰", "É"), ("Ã“", "Ó"),
    ("Ãš", "Ú"), ("Ã€", "À"), ("Ã•", "Õ"), ("Ã‚", "Â"), ("Ãƒ", "Ã"), ("Ã„", "Ä"), ("â€œ", "\u201c"), ("â€\u009d", "\u201d"),
    ("â€˜", "\u2018"), ("â€™", "\u2019"), ("â€“", "\u2013"), ("â€”", "\u2014"), ("â€¦", "\u2026"),
]

# --- listing pages -------------------------------------------------------------------------
CONTAINER_SELECTORS = [
    "li.oferta", "div.oferta", "li.anuncio", "div.anuncio", "li.job", "div.job",
    "li.job-item", "div.job-item", "div.oferta-emprego", "li.oferta-emprego",
    "div.resultado", "li.resultado", "tr.oferta", "tr.anuncio", "div.vaga", "li.vaga",
]
TITLE_SELECTORS = [".titulo", ".title", "h1", "h2", "h3", "h4", ".nome", ".cargo"]
COMPANY_SELECTORS = [".empresa", ".company", ".entidade", ".empregador", ".employerName", ".employer"]
PLACE_SELECTORS = [".local", ".localidade", ".location", ".cidade", ".distrito", ".zona"]
DATE_SELECTORS = [".data", ".date", ".publicacao", ".publicado", ".datapub", ".dt"]

ASSET_PATTERN = r"\.(css|js|gif|jpg|jpeg|png|ico|swf|pdf|zip|xml|rss)(\?|$)"
ASSET_PATTERN_NO_ZIP = r"\.(css|js|gif|jpg|jpeg|png|ico|swf|pdf|xml|rss)(\?|$)"
NAV_PATH_PATTERN = r"/(page|category|tag|author|contatos|sobre-nos|feed|comments|author)/|\?p="
REPLAY_PREFIX = r"(?:https?://[^/]+)?/(?:noFrame/replay|wayback)/\d{14}[a-z_]*/"
JOB_LINK_PATTERN = (
    r"/emprego/[a-z0-9][a-z0-9\-/]*/?|/vagas?/\d+|[?&]ref=\d+|/\d{5,}"
    r"|VacancyDet|vacancydet|JobDet|AnuncioDet|vaczoeker"
)
DATE_PATTERN = r"\b(\d{2}[./-]\d{2}[./-]\d{4})\b"

CHROME_TEXT_PATTERN = (
    r"(voucher|tablet|assinatura|login|registo|e-learning|rss|digital"
    r"|imobiliário|anunciar|partilhar|newsletter|publicidade|landing page"
    r"|trabalho temporário|divulgar|recrutadores|formação|empreendedor"
    r"|responsabilidade social|dossiers|gerir carreiras)"
)
NAV_TEXT_PATTERN = (
    r"^(my portal|todos os an[úu]ncios|pesquisa avan[çc]ada|empresas\s*rh"
    r"|sal[áa]rios|franchising|registo|login|newsletters?|agenda"
    r"|emprego p[úu]blico|trabalho tempor[áa]rio|gerir cv|cv online"
    r"|alertas? de emprego|criar alerta|mapa do site|contactos?"
    r"|publicitar|anunciar vaga|sobre n[óo]s|quem somos|ajuda|faqs?"
    r"|pol[íi]tica de privacidade|termos|forma[çc][ãa]o|est[áa]gios?"
    r"|empreendedorismo|cursos?|bolsa de emprego|candidatos?"
    r"|recrutadores?|empregadores?|parceiros?|[áa]rea pessoal"
    r"|aceder|entrar|sair|home|in[íi]cio|p[áa]gina principal"
    r"|ver (mais|todos|todas)|mais (ofertas|vagas|an[úu]ncios))$"
)
EDITORIAL_TEXT_PATTERN = (
    r"(perde \d+ pontos|culpa governo|faz com[íi]cio|\bps\b|\bpsd\b|\bcds\b|\bbe\b"
    r"|freeport|euro(peias|zona)|ministr[ao]|parlamento|presidente da rep[úu]blica"
    r"|premi[êe]r|partidos?|elei[çc][õo]es?|resultado.*jogo|marcador)"
)
ANONYMOUS_COMPANY = "Anónimo"

# --- month names of posting dates, both languages ------------------------------------------
MONTHS = {
    "janeiro": 1, "fevereiro": 2, "março": 3, "abril": 4, "maio": 5, "junho": 6,
    "julho": 7, "agosto": 8, "setembro": 9, "outubro": 10, "novembro": 11, "dezembro": 12,
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6,
    "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
}

# --- productive snapshots allowed per year ----------------------------------------------------
SNAPSHOTS_PER_YEAR = {2011: 10, 2012: 10, 2016: 10, 2023: 3, 2024: 3, 2025: 3}
SNAPSHOTS_PER_YEAR_DEFAULT = 5
