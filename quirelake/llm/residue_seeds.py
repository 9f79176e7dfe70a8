"""What template residue, filler, error pages and notices look like.

These lines train the residue models. They are the usual wordings, in several
languages; none stands word for word in the test documents, and the models generalise
over their character n-grams.
"""

FILLER = """
das ist nur ein blindtext, der die seite füllen soll. ein blindtext dient dazu, seiten zu füllen, bis der richtige text da ist. platzhaltertext
type the name of the author here. add the names of the authors. will be added later
lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua
ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat
duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur
excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum
lorem ipsum lorem ipsum lorem ipsum
dummy text dummy text dummy text placeholder content placeholder placeholder text
body copy heading 1 heading 2 body copy content placeholder dummy heading
this is dummy text. this is sample text. this is placeholder text. replace this text with your own
an dieser stelle steht später der richtige text
ceci est un faux texte destiné à remplir la page. texte provisoire
este es un texto de relleno. texto de ejemplo
texto de preenchimento. este é um texto provisório
текст-заполнитель. здесь будет текст. пример текста
asdf asdf asdf asdf asdf qwerty qwerty qwerty asdfasdf asdf jkl
xxx xxx xxx xxx xxx xxxx xxxx xxxxx
test test test test test testing testing 123 test page please ignore
foo bar baz foo bar baz blah blah blah blah
abstract: todo keywords: todo title: todo authors: todo tbd tbc
funding: tbc corresponding author: tbc affiliation: tbd summary: tba
text goes here. your text here. insert text here. enter the abstract here. type your text
click to edit. add the description in this box. add your description here; leave no blank fields. fill in this field
coming soon. content coming soon. to be completed. under construction
write your abstract here. paste the text here
please replace this paragraph with a summary of at most 200 words. delete this line before you submit
instructions to authors: state the aim, the methods and the results in this paragraph
hier steht der text. bitte ersetzen sie diesen absatz. remplacez ce paragraphe. reemplace este párrafo. substitua este parágrafo
no content available. no description provided. this page was left blank
"""

ERRORS = """
oops, there was a problem on our side. something is wrong here. our team has been told about the problem
не найдена такая страница. запрошенная страница не существует. проверьте правильность адреса. вернитесь на главную страницу сайта
erro ao carregar a página. ocorreu um problema ao abrir o artigo. tente de novo mais tarde. tente novamente em alguns minutos. não foi possível carregar o documento
sie haben keine berechtigung, diese seite zu öffnen. der zugriff auf dieses dokument wurde verweigert. diese seite wurde leider nicht gefunden
la page que vous cherchez est introuvable. une erreur interne s'est produite sur le serveur. vous n'avez pas accès à ce document
la página que busca no se encontró. el documento no existe. el documento fue retirado. error al abrir el artículo
<error><code>accessdenied</code><message>access denied</message><requestid>0a1b</requestid></error> the specified bucket does not exist. no such key
404 page not found. 502 server error. 503 server unavailable. 500 server error
the server gave an empty response. the item gave an empty response. the record failed to load. the article could not be opened. we are sorry for the inconvenience. we apologise for any trouble
your session is over. log in once more to go on. your request was blocked. too many requests were made. please try again shortly. back to the search form
subscription needed. your library has no subscription to this journal. the file is not available at the moment
error 404: page not found
the page you requested could not be found. the requested url was not found on this server
sorry, the page you are looking for does not exist or has been moved.
please try again later
500 internal server error. an internal server error occurred
error 504: gateway timeout
502 bad gateway nginx. 503 service unavailable. 504 gateway timeout. 403 forbidden. 429 too many requests
access denied. you do not have permission to access this resource.
access to this page has been denied. your request was blocked by the proxy
request blocked by the upstream proxy: rate limit exceeded, retry after 60 seconds
please slow down and retry after some seconds
this site is down for maintenance. the site is down for scheduled maintenance. we will be back soon
service temporarily unavailable due to maintenance
your session timed out, sign in again to continue reading
you are not logged in. please sign in to view this content. login required
buy this article or log in to read. this content is for subscribers only
an error occurred while processing your request. please contact the administrator
connection timed out. could not connect to the database. database connection error. mysql error
fatal error: uncaught exception. warning: undefined variable on line 12
traceback (most recent call last): file "app.py", line 120, in render keyerror: 'title'
file "/srv/app/views.py", line 88, in view typeerror: nonetype object is not subscriptable valueerror attributeerror
java.lang.nullpointerexception at com.example.servlet.service
{"status":404,"error":"not found","message":"no such record","path":"/api/v1/records/1"}
{"status":500,"error":"internal server error","path":"/v1/items/a1"} {"status":503,"error":"service unavailable"}
the document failed to load
the full text cannot be displayed.
this page was moved without a forwarding address. the document is no longer here.
quote code 12345 if the problem persists. contact the help desk and quote the reference. session 0a1b2c3d
das dokument konnte nicht geladen werden. le document n'a pas pu être chargé. une erreur est survenue lors du chargement
se produjo un error al cargar el artículo.
не удалось загрузить статью. произошла ошибка при загрузке. документ недоступен
trace id 5f3c9a1b. request id 8f2e. reference number. incident id
undefined undefined null [object object] nan undefined null undefined
nan views nan citations null null undefined
die seite wurde nicht gefunden. fehler 404
interner serverfehler. ihre sitzung ist abgelaufen
page introuvable. erreur 404. accès refusé
error interno del servidor. acceso denegado. la página solicitada no existe
página não encontrada. erro interno do servidor. acesso negado. a página solicitada não existe
ошибка 404. внутренняя ошибка сервера. доступ запрещён
"""

NOTICES = """
enable javascript to run this application. this application needs javascript. please enable javascript to read this article
bitte schalten sie javascript ein, um den text anzuzeigen. activez javascript pour lire ce document. active javascript en el navegador para ver este contenido. ative o javascript no navegador para ler o texto
checking the connection to this site. prove that you are human by completing the check. still loading. nothing to see unless scripts are allowed
turn on scripting and load the page again. your web browser is not supported by this site. update it to see the full text. switch off the ad blocker
please enable javascript to view this page.
javascript is required. this site requires javascript
turn on javascript and reload the page
this page requires scripts.
this reader needs scripts to load the document.
switch on cookies and javascript to load the reader
cookies are disabled. please enable cookies and try again. this site uses cookies. accept cookies to continue
allow active content in the settings to continue.
you must allow cookies for this site to continue. enable js to display formulas.
you will be redirected. slide to continue. press and hold the button
your browser is out of date. please update your browser. this browser is no longer supported in your device
loading article… please wait
checking your browser before accessing the site.
verify you are human. please complete the captcha. i am not a robot
checking if the site connection is secure. this process is automatic. ddos protection. ray id
bitte aktivieren sie cookies. ihr browser wird nicht unterstützt
veuillez activer les cookies. votre navigateur n'est pas pris en charge
active las cookies. su navegador no es compatible
ative o javascript. seu navegador não é compatível
включите javascript в браузере, чтобы прочитать статью. включите поддержку сценариев. ваш браузер не поддерживается
"""

# Words of sentences that talk about templates, messages and code instead of being left over from them.
MENTIONS = ("template engine", "templates", "slots", "syntax", "script:", "scripts:", "macro", "regex", "source code", "code listing", "format with", "such as", "for example", "e.g.", "the notice", "the message", "the phrase", "the string", "the term", "die meldung", "le message", "el mensaje", "a mensagem", "сообщение", "надпись", "quoted", "dummy text such")
