"""Labelled exemplars of residue: ``family | label | text``, the table that is used where the caller gives none."""

# Notices and placeholders as they are found on the public web; a family is a kind of
# notice in one language, the core families hold what many wordings have in common.
EXEMPLARS = """
core-scripts | scripts | please enable javascript
core-scripts | scripts | javascript is disabled in browser
core-scripts | scripts | javascript must be enabled browser
core-scripts | scripts | page requires javascript
core-scripts | scripts | without javascript page
core-scripts | scripts | enable javascript and cookies
core-notices | error | sorry the page you requested could not be found
core-notices | error | access denied you don't have permission
core-notices | error | please log in to continue
core-notices | error | session has expired please log in
core-notices | error | internal server error
core-notices | error | service temporarily unavailable
core-notices | error | try again later server
core-notices | error | an error has occurred please try
core-notices | error | contact the site administrator
core-notices | error | uncaught exception stack trace
core-notices | error | query failed sql error
core-notices | error | your session timed out please log in again
core-notices | error | traceback most recent call last
core-notices | error | java lang outofmemoryerror heap space
core-notices | error | restricted to subscribers access
core-notices | error | sign in to view this article
core-notices | error | too many requests please slow down
core-notices | error | server is down for maintenance please check back
core-scripts | scripts | verify you are human
core-stubs | template | abstract to be added
core-stubs | template | abstract will be added later
core-scripts | scripts | enable javascript
core-scripts | scripts | javascript disabled
core-scripts | scripts | javascript disabled in your browser
core-notices | error | cannot connect to the database
core-notices | error | you have been blocked
core-notices | error | sorry the page you are looking for doesn't exist
core-notices | error | request has timed out
core-notices | error | database server has gone away
core-notices | error | log in with your account to read
access | error | access denied your request was blocked by the security rules of
access | error | you do not have permission to view this content please sign in with your institution
access | error | forbidden no access from your network code
access | error | your session has expired log in again to continue
access | error | too many requests were sent from your address slow down and retry later
access | error | login required to view the abstract
access | error | please log in to view this content
access | error | you must be logged in to access this page
access | error | 401 unauthorized
access | error | 403 forbidden you don't have permission to access this resource
access | error | access to this page has been denied
access | error | purchase access or sign in to read the full abstract
access | error | subscription required to view this content
not-found | error | the page you are looking for may have been moved or deleted
not-found | error | 404 not found the requested record could not be located on this server
not-found | error | error 404 we cannot find the page that you asked for
not-found | error | sorry this record does not exist or is no longer available at this address
not-found | error | page introuvable le document n'existe pas ou a été déplacé
not-found | error | seite nicht gefunden der datensatz ist nicht vorhanden
not-found | error | the resource is gone code
not-found | error | the requested url was not found on this server
not-found | error | oops that page can't be found
not-found | error | página no encontrada
not-found | error | pagina non trovata
program | error | java lang nullpointerexception at render java while reading
program | error | traceback most recent call last file line in render keyerror
program | error | warning undefined array key in php on line
program | error | sqlstate column not found statement field
program | error | the connection to the database failed
program | error | ora-00942 table or view does not exist
program | error | error establishing a database connection
program | error | you have an error in your sql syntax check the manual
program | error | fatal error uncaught exception in on line
program | error | exception in thread main java lang
program | error | segmentation fault core dumped
program | error | uncaught typeerror cannot read property of undefined
server | error | 如果问题仍然存在 请联系管理员处理
server | error | something went wrong on our end code
server | error | 503 service temporarily unavailable down for maintenance ticket
server | error | 502 bad gateway edge node try again in a few minutes
server | error | 504 gateway time-out no reply from upstream
server | error | http status 500 internal server error the server met an unexpected condition
server | error | an unexpected error has occurred please contact the administrator and quote
server | error | internal error 0x0 please reload the page
server | error | error loading metadata timeout after ms
server | error | error the record could not be loaded completely
server | error | gateway timeout
server | error | 502 bad gateway
server | error | request timed out please try again later
server | error | internal server error please contact the webmaster
server | error | service unavailable the server is temporarily unable to service your request
server | error | the site is currently under maintenance please check back later
server | error | sorry an error occurred while processing your request
server | error | connection refused
server | error | this site can't be reached
filler-abc | filler | abc abc abc 123 123 123 abc abc abc
filler-asdf | filler | asdf asdf qwer asdf asdf qwer
filler-echo | filler | blah blah blah blah blah
filler-foo | filler | foo bar foo bar foo bar
filler-lorem | filler | lorem ipsum dolor sit amet consectetur adipiscing elit
filler-lorem | filler | lorem ipsum
filler-mash | filler | sdfg hjkl fghj
filler-xs | filler | xxx xxxx xxx xxxx
browser-check | scripts | checking your browser before you are sent to this takes up to five seconds
browser-check | scripts | please complete the captcha to prove that you are human
browser-check | scripts | please wait while we verify that you are not a robot
browser-check | scripts | please enable cookies to continue
scripts-de | scripts | bitte aktivieren sie javascript um den inhalt dieser seite anzuzeigen
scripts-de | scripts | diese seite benötigt javascript bitte in den einstellungen des browsers einschalten
scripts-en | scripts | please enable javascript to view this page
scripts-en | scripts | please enable javascript to see the references
scripts-en | scripts | please enable javascript in your browser and reload
scripts-en | scripts | you need to enable javascript to run this app
scripts-en | scripts | you need to allow cookies and javascript in order to read the abstract on
scripts-en | scripts | javascript is disabled in your browser some features of will not work
scripts-en | scripts | javascript is required to use this site
scripts-en | scripts | does not work properly without javascript enabled
scripts-en | scripts | we are sorry but does not work properly without javascript
scripts-en | scripts | this site requires scripts turn them on in the settings of your browser and reload
scripts-en | scripts | your browser does not support scripting or scripting has been switched off
scripts-en | scripts | you are using an outdated browser scripts are needed to display this content
scripts-en | scripts | this application needs scripting to run
scripts-en | scripts | you must have scripts turned on to use all features of this page
scripts-en | scripts | to continue please turn on javascript in your browser settings
scripts-en | scripts | this page requires javascript to be enabled
scripts-en | scripts | your browser has javascript turned off
scripts-es | scripts | habilite javascript en su navegador para poder leer el resumen
scripts-es | scripts | active javascript en su navegador para ver esta página
scripts-es | scripts | debe activar javascript para continuar
scripts-fr | scripts | veuillez activer javascript dans votre navigateur pour afficher cette page
scripts-fr | scripts | ce site nécessite javascript pour fonctionner
scripts-it | scripts | attiva javascript nel tuo browser per visualizzare questa pagina
scripts-it | scripts | per favore abilita javascript per continuare
scripts-nl | scripts | schakel javascript in om deze pagina te bekijken
scripts-pl | scripts | włącz obsługę javascript w przeglądarce aby zobaczyć tę stronę
scripts-pt | scripts | ative o javascript no seu navegador para ver esta página
scripts-zh | scripts | 请启用 javascript 后重新加载本页面 以便查看摘要内容
placeholder-braces | template | {{ title }}
placeholder-braces | template | {title}
placeholder-braces | template | {$title}
placeholder-braces | template | ${title}
placeholder-braces | template | {% block title %}
placeholder-brackets | template | [[title]]
placeholder-brackets | template | [Insert title here]
placeholder-marks | template | %%TITLE%%
placeholder-marks | template | <% title %>
placeholder-marks | template | <<TITLE>>
placeholder-marks | template | ##title##
placeholder-marks | template | @@title@@
placeholder-output | template | %1$s
placeholder-output | template | #REF!
placeholder-output | template | [object Object]
placeholder-output | template | ____
stub | template | abstract text goes here
stub | template | your abstract will appear in this place
stub | template | type or paste your abstract into this box
stub | template | insert abstract of at most words
stub | template | this is sample text for the summary field
stub | template | todo write the abstract
stub | template | text to come
stub | template | text to come batch
stub | template | title by author in proceedings publisher city year
stub | template | see the source sheet for the summary
stub | template | placeholder for the summary of item to be supplied by the authors
stub | template | dummy record used for testing the import please ignore
stub | template | this field is filled automatically replace it before release
stub | template | tbd
stub | template | to be announced
stub | template | to be determined
stub | template | no abstract text has been entered
stub | template | click here to edit this text
stub | template | enter your abstract here
stub | template | abstract not yet written
stub | template | replace this text with your summary
undefined | template | undefined undefined undefined undefined pp nan-nan
undefined | template | null null null null null null
"""


def rows() -> list[tuple[str, str, str]]:
    return [tuple(part.strip() for part in line.split("|", 2)) for line in EXEMPLARS.strip().splitlines()]
