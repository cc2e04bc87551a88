"""Word lists and phrases whose content decides results. Plain, in natural order."""

# signals of query types
NEWS_SIGNALS = ["latest", "today", "breaking", "news", "update", "announce", "report", "yesterday", "this week", "recent"]
RESEARCH_SIGNALS = ["study", "research", "paper", "analysis", "impact", "effect", "evidence", "systematic", "review", "meta-analysis", "journal"]
TECHNICAL_SIGNALS = [
    "api", "code", "function", "error", "bug", "implement", "library", "framework", "documentation", "tutorial", "how to", "example", "syntax",
    "install", "config", "setup",
]
FACTUAL_SIGNALS = ["what is", "who is", "when did", "where is", "how many", "definition", "meaning", "capital of", "population"]

# topic words of query rewriting
TECHNICAL_TOPICS = [
    "api", "code", "programming", "library", "framework", "install", "setup", "config", "error", "debug", "function", "method", "class", "module",
    "package", "rust", "python", "javascript", "typescript", "docker", "kubernetes", "database", "sql", "linux", "git",
]
SCIENTIFIC_TOPICS = [
    "study", "research", "hypothesis", "experiment", "data", "analysis", "correlation", "evidence", "peer-reviewed", "journal", "methodology",
    "findings", "meta-analysis",
]
MEDICAL_TOPICS = [
    "treatment", "diagnosis", "symptoms", "disease", "therapy", "clinical", "patient", "drug", "medication", "health", "cancer", "diabetes",
    "cardiac", "vaccine",
]
NEWS_TOPICS = ["news", "latest", "today", "breaking", "update", "announcement", "recent", "current", "happening"]
SYNONYMS = [
    ("impact", ["effect", "influence"]), ("effect", ["impact", "consequence"]), ("cause", ["lead to", "result in"]),
    ("prevent", ["avoid", "mitigate"]), ("benefit", ["advantage", "positive effect"]), ("drawback", ["disadvantage", "limitation"]),
    ("risk", ["danger", "threat", "vulnerability"]), ("opportunity", ["potential", "prospect"]), ("fast", ["quick", "rapid", "high-performance"]),
    ("slow", ["sluggish", "poor performance"]), ("efficient", ["optimized", "streamlined"]), ("scalable", ["extensible", "high-throughput"]),
    ("improve", ["enhance", "optimize", "boost"]), ("reduce", ["decrease", "minimize", "lower"]), ("create", ["build", "develop", "implement"]),
    ("remove", ["delete", "eliminate", "drop"]), ("fix", ["resolve", "patch", "repair"]), ("deploy", ["release", "ship", "launch"]),
    ("compare", ["versus", "vs", "difference between"]), ("best", ["top", "recommended", "optimal"]),
    ("alternative", ["replacement", "substitute", "instead of"]), ("latest", ["recent", "new", "current"]),
    ("outdated", ["deprecated", "legacy", "obsolete"]), ("research", ["study", "analysis", "investigation"]),
    ("evidence", ["data", "proof", "findings"]), ("climate change", ["global warming", "climate crisis"]),
    ("machine learning", ["ML", "artificial intelligence"]), ("artificial intelligence", ["AI", "machine learning"]),
    ("deep learning", ["neural networks", "DL"]), ("natural language processing", ["NLP", "text analysis"]),
    ("cybersecurity", ["information security", "infosec"]), ("cryptocurrency", ["crypto", "digital currency"]),
    ("blockchain", ["distributed ledger", "DLT"]), ("open source", ["OSS", "FOSS"]), ("cloud computing", ["cloud infrastructure", "IaaS"]),
    ("container", ["docker", "containerization"]), ("microservices", ["service-oriented", "distributed services"]),
    ("devops", ["CI/CD", "continuous delivery"]), ("startup", ["early-stage company", "venture"]),
    ("remote work", ["work from home", "distributed team"]),
]

# page quality
NO_RESULT_PHRASES = [
    "no results matching", "no results found", "your search did not match", "did not return any results", "0 results", "no documents match",
    "there were no results",
]
BLOCK_PHRASES = [
    "please verify you are a human", "complete the captcha", "access denied", "403 forbidden", "enable javascript to continue",
    "please enable cookies", "checking your browser", "just a moment...",
]
AGGREGATOR_PHRASES = [
    "top stories", "trending now", "more headlines", "latest news", "breaking news", "see more headlines", "follow this topic", "chevron_right",
]
NAV_PHRASES = ["privacy policy", "terms of use", "cookie policy", "sign in", "log in", "create account"]
SERP_URL_PARTS = ["/search?", "/search/?", "?q=", "?query=", "/releases/search", "/packages?", "/repositories?", "special:search", "/w/index.php?search"]
CODE_STARTS = [
    "fn ", "pub fn ", "async fn ", "impl ", "struct ", "enum ", "trait ", "mod ", "use ", "#[", "//", "/*", "*/", "def ", "class ", "import ",
    "from ", "__", "function ", "const ", "let ", "var ", "=>", "#include", "int main", "void ", "std::", "namespace ", "package ",
    "public class", "private ", "protected ",
]
CTA_PHRASES = [
    "contact us", "sign up", "subscribe", "free trial", "get started", "book a demo", "schedule a call", "request a quote", "click here",
    "download now", "buy now", "order now", "follow us on", "share this", "tweet this", "cookie policy", "privacy policy", "terms of service",
    "all rights reserved", "copyright ©", "powered by", "free consultation", "free estimate",
]
EDITORIAL_MARKERS = [
    "citation needed", "edit", "note", "nb", "clarification needed", "when?", "who?", "where?", "which?", "what?", "why?", "how?", "dubious",
    "discuss", "disputed", "unreliable source", "unreliable source?", "better source needed", "failed verification", "not in citation given",
    "original research?", "primary source needed", "year needed", "page needed", "full citation needed", "dead link", "permanent dead link",
    "self-published source", "self-published source?", "update", "needs update",
]
MONTH_NAMES = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]

# words without weight: of the summariser, and of the hash embedder
SUMMARY_STOPWORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might shall can to of in for on with at by from as "
    "into through during before after above below between under again further then once here there when where why how all each every both few more "
    "most other some such no nor not only own same so than too very and but or if while that this it its also just about which their them they what "
    "who whom these those"
).split()
EMBED_STOPWORDS = (
    "the is at which on a an and or but in with to for of not no can had has have it its was were will be been being do does did this that these "
    "those am are if by from up out so than too very just about into through during before after above below between each all both few more most "
    "other some such only own same then when where why how what who whom he she they we you me him her us them my your his our their"
).split()

# words that tell a language
LANGUAGE_WORDS = {
    "en": "the is are was were and that this with have for not but from".split(),
    "es": "que los las una con para por como más pero del esta".split(),
    "fr": "les des une que est pas dans pour sur avec plus cette".split(),
    "de": "der die das und ist ein eine nicht mit auf den auch".split(),
    "pt": "que não para uma com dos das mais como esta pela".split(),
}

# authority of domains: suffixes of the first tier, and short example lists that callers replace by a table
TIER1_SUFFIXES = [".gov", ".edu", ".ac.uk", ".mil"]
# Domains of the three upper tiers.
TIER_DOMAINS = {
    1: (
        "nature.com science.org sciencedirect.com springer.com thelancet.com bmj.com nejm.org cell.com pnas.org arxiv.org pubmed.ncbi.nlm.nih.gov scholar.google.com "
        "jstor.org wiley.com tandfonline.com oup.com cambridge.org sagepub.com ssrn.com researchgate.net w3.org ietf.org ieee.org acm.org iso.org "
        "who.int nasa.gov nist.gov worldbank.org cdc.gov nih.gov fda.gov epa.gov sec.gov un.org europa.eu imf.org oecd.org "
        "data.gov census.gov bls.gov usda.gov energy.gov defense.gov state.gov"
    ).split(),
    2: (
        "reuters.com apnews.com bbc.com bbc.co.uk nytimes.com washingtonpost.com theguardian.com npr.org cnn.com cnbc.com forbes.com bloomberg.com ft.com economist.com wsj.com "
        "usatoday.com latimes.com theatlantic.com politico.com axios.com time.com newsweek.com news.google.com news.yahoo.com abcnews.go.com nbcnews.com cbsnews.com foxnews.com "
        "techcrunch.com theverge.com arstechnica.com wired.com zdnet.com cnet.com engadget.com anandtech.com tomshardware.com servethehome.com theregister.com infoworld.com computerworld.com "
        "fortune.com businessinsider.com hbr.org investopedia.com marketwatch.com seekingalpha.com "
        "docs.python.org docs.rs doc.rust-lang.org developer.mozilla.org developer.apple.com developer.android.com developers.google.com learn.microsoft.com cloud.google.com aws.amazon.com "
        "docs.aws.amazon.com azure.microsoft.com docs.oracle.com docs.docker.com kubernetes.io react.dev vuejs.org angular.io nextjs.org nodejs.org go.dev www.typescriptlang.org "
        "en.wikipedia.org wikipedia.org wikidata.org wikimedia.org britannica.com stackoverflow.com github.com docs.github.com gitlab.com cppreference.com man7.org "
        "openai.com anthropic.com deepmind.google ai.meta.com nvidia.com developer.nvidia.com intel.com amd.com qualcomm.com apple.com microsoft.com google.com "
        "mayoclinic.org webmd.com healthline.com sciencedaily.com newscientist.com livescience.com phys.org scientificamerican.com"
    ).split(),
    3: (
        "medium.com dev.to hashnode.dev substack.com dzone.com baeldung.com freecodecamp.org css-tricks.com smashingmagazine.com digitalocean.com tutorialspoint.com geeksforgeeks.org w3schools.com "
        "reddit.com old.reddit.com news.ycombinator.com quora.com stackexchange.com lobste.rs slashdot.org discourse.org wordpress.com blogspot.com tumblr.com ghost.org notion.site "
        "techtarget.com techrepublic.com pcmag.com howtogeek.com makeuseof.com lifehacker.com statista.com kaggle.com huggingface.co paperswithcode.com distill.pub"
    ).split(),
}
DOUBLE_SUFFIXES = ["co.uk", "com.au", "co.jp", "co.kr", "com.br", "co.in"]
# Entities and the domains that are official for them, one entity a line.
OFFICIAL_DOMAINS = [
    (name.strip(), domains.split())
    for name, domains in (
        line.split(":")
        for line in """
chatgpt: openai.com
gpt-5: openai.com
gpt-4: openai.com
gpt-4o: openai.com
dall-e: openai.com
openai: openai.com platform.openai.com
claude: anthropic.com docs.anthropic.com
anthropic: anthropic.com docs.anthropic.com
gemini: deepmind.google ai.google
deepmind: deepmind.google
google ai: ai.google deepmind.google
bard: ai.google
copilot: github.com copilot.microsoft.com
llama: ai.meta.com llama.meta.com
meta ai: ai.meta.com
mistral: mistral.ai
cohere: cohere.com
stability ai: stability.ai
stable diffusion: stability.ai
midjourney: midjourney.com
hugging face: huggingface.co
huggingface: huggingface.co
perplexity: perplexity.ai
h100: nvidia.com developer.nvidia.com
h200: nvidia.com developer.nvidia.com
b200: nvidia.com developer.nvidia.com
b100: nvidia.com developer.nvidia.com
gb200: nvidia.com developer.nvidia.com
a100: nvidia.com developer.nvidia.com
rtx 5090: nvidia.com
rtx 4090: nvidia.com
cuda: developer.nvidia.com
tensorrt: developer.nvidia.com
nvidia: nvidia.com developer.nvidia.com
radeon: amd.com
ryzen: amd.com
epyc: amd.com
rocm: amd.com
amd: amd.com
intel arc: intel.com
xeon: intel.com
core ultra: intel.com
intel: intel.com
apple silicon: apple.com
m4 chip: apple.com
qualcomm: qualcomm.com
snapdragon: qualcomm.com
aws: aws.amazon.com docs.aws.amazon.com
amazon web services: aws.amazon.com
ec2: aws.amazon.com
lambda aws: aws.amazon.com
s3 bucket: aws.amazon.com
azure: azure.microsoft.com learn.microsoft.com
gcp: cloud.google.com
google cloud: cloud.google.com
firebase: firebase.google.com
vercel: vercel.com
netlify: netlify.com
cloudflare: cloudflare.com
digitalocean: digitalocean.com
supabase: supabase.com
rust lang: rust-lang.org doc.rust-lang.org
rustup: rust-lang.org
cargo crate: crates.io doc.rust-lang.org
python: python.org docs.python.org
pip install: pypi.org
typescript: typescriptlang.org
javascript: developer.mozilla.org
golang: go.dev
kotlin: kotlinlang.org
swift lang: swift.org developer.apple.com
java jdk: oracle.com openjdk.org
csharp: learn.microsoft.com
dotnet: dotnet.microsoft.com
react: react.dev
nextjs: nextjs.org
next.js: nextjs.org
vue.js: vuejs.org
vuejs: vuejs.org
angular: angular.io angular.dev
svelte: svelte.dev
django: djangoproject.com
flask: flask.palletsprojects.com
fastapi: fastapi.tiangolo.com
spring boot: spring.io
laravel: laravel.com
rails: rubyonrails.org
express.js: expressjs.com
tailwind: tailwindcss.com
pytorch: pytorch.org
tensorflow: tensorflow.org
docker: docker.com docs.docker.com
kubernetes: kubernetes.io
terraform: terraform.io
ansible: ansible.com
postgresql: postgresql.org
postgres: postgresql.org
mysql: mysql.com dev.mysql.com
mongodb: mongodb.com
redis: redis.io
elasticsearch: elastic.co
sqlite: sqlite.org
cockroachdb: cockroachlabs.com
planetscale: planetscale.com
iphone: apple.com
ipad: apple.com
macbook: apple.com
apple: apple.com
windows 11: microsoft.com
microsoft: microsoft.com
google search: google.com
chrome: google.com chromium.org
android: developer.android.com android.com
pixel phone: store.google.com
samsung galaxy: samsung.com
samsung: samsung.com
tesla: tesla.com
spacex: spacex.com
github: github.com docs.github.com
gitlab: gitlab.com
bitbucket: bitbucket.org
jira: atlassian.com
confluence: atlassian.com
slack api: api.slack.com
discord bot: discord.com
figma: figma.com
notion: notion.so
linear: linear.app
stripe: stripe.com docs.stripe.com
twilio: twilio.com
sendgrid: sendgrid.com
auth0: auth0.com
okta: okta.com
datadog: datadoghq.com
grafana: grafana.com
sentry: sentry.io
npm: npmjs.com
yarn: yarnpkg.com
ethereum: ethereum.org
solana: solana.com
bitcoin: bitcoin.org
polygon: polygon.technology
chainlink: chain.link
""".strip().splitlines()
    )
]

# parts of URLs and hosts of the frontier's bonus
FRONTIER_BONUS = [(0.3, [".gov", ".edu", "wikipedia.org"]), (0.2, ["stackoverflow.com", "github.com", "arxiv.org"]), (0.1, [".org"])]
