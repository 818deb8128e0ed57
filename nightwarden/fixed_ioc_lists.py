"""The default indicator lists, one entry per line.

Sites normally point the readers at their own list files; these are the defaults.
"""

DOMAINS = """
*.cobaltstrike.com
update.cobaltstrike.com
beacon.cobaltstrike.com
*.ddns.net
*.no-ip.org
*.hopto.org
*.zapto.org
*.servegame.com
*.serveminecraft.net
*.myftp.biz
*.myftp.org
*.redirectme.net
*.serveblog.net
*.servehttp.com
*.serveftp.com
185.220.101.182.sslip.io
cmstrack.top
gotomailer.com
freshdesk-cdn.net
office365-cdn-update.com
windowsupdate-cdn.live
cdn-microsoft-update.com
svchost-update.net
winlogon-update.com
taskhost-cdn.net
secure-docusign-verify.com
docusign-secure-portal.net
microsoft-account-verify.net
office365-login-secure.com
sharepoint-file-request.net
onedrive-file-shared.com
google-drive-shared-doc.com
dropbox-secure-link.net
adobe-sign-request.com
linkedin-message-secure.net
pastebin.com
paste.ee
ghostbin.co
controlc.com
hastebin.com
*.ngrok.io
*.ngrok-free.app
*.loca.lt
*.serveo.net
*.trycloudflare.com
*.onion.to
*.onion.ly
*.onion.pet
*.tor2web.org
*.tor2web.fi
coinhive.com
minegate.pw
crypto-loot.com
monerise.com
webmine.pro
xmrig.com
"""

ADDRESSES = """
185.220.101.0/24
185.220.100.0/24
185.220.102.0/24
199.87.154.0/24
5.188.86.0/24
194.165.16.0/24
45.142.212.0/24
77.73.133.0/24
91.92.109.0/24
194.147.140.0/24
45.33.32.156
198.199.80.0/24
159.203.0.0/18
104.236.0.0/16
198.20.69.0/24
198.20.70.0/24
198.20.74.0/24
198.20.99.0/24
66.240.192.0/19
80.82.77.0/24
93.120.27.0/24
162.142.125.0/24
167.94.138.0/24
167.94.145.0/24
167.94.146.0/24
185.220.101.34
185.220.101.35
185.220.101.36
185.220.101.47
185.107.47.171
185.129.62.62
46.165.230.5
"""

PROCESS_NAMES = """
mimikatz.exe
mimilib.dll
mimidrv.sys
wce.exe
fgdump.exe
pwdump.exe
pwdump7.exe
procdump.exe
gsecdump.exe
cachedump.exe
meterpreter.exe
beacon.exe
cobaltstrike.exe
powershell_empire.exe
empire.exe
covenant.exe
havoc.exe
brute_ratel.exe
ncat.exe
plink.exe
psexec.exe
psexec64.exe
paexec.exe
remcom.exe
winexe.exe
wmiexec.exe
smbexec.exe
dcomexec.exe
atexec.exe
bloodhound.exe
sharphound.exe
sharpview.exe
adrecon.exe
pingcastle.exe
powerview.ps1
rubeus.exe
kerbrute.exe
kerberoast.exe
nmap.exe
masscan.exe
zmap.exe
nbtscan.exe
netview.exe
superscan.exe
angry_ip_scanner.exe
advanced_ip_scanner.exe
metasploit.exe
msfconsole.exe
msfvenom.exe
ngrok.exe
chisel.exe
ligolo.exe
frpc.exe
frps.exe
iodine.exe
dnscat.exe
dnscrypt-proxy.exe
vssadmin.exe
wbadmin.exe
bcdedit.exe
invoke-obfuscation.ps1
invoke-cradle.ps1
bypas.exe
amsibypass.exe
disableavsvc.exe
seatbelt.exe
sharpup.exe
sharpwmi.exe
sharprdp.exe
sharpsocks.exe
sharpchisel.exe
inveigh.exe
responder.exe
inveigh-relay.exe
"""

PROCESS_CHAINS = """
winword.exe -> powershell.exe
winword.exe -> cmd.exe
winword.exe -> wscript.exe
winword.exe -> cscript.exe
winword.exe -> mshta.exe
winword.exe -> regsvr32.exe
winword.exe -> rundll32.exe
excel.exe -> powershell.exe
excel.exe -> cmd.exe
excel.exe -> wscript.exe
excel.exe -> cscript.exe
excel.exe -> mshta.exe
excel.exe -> regsvr32.exe
excel.exe -> rundll32.exe
outlook.exe -> powershell.exe
outlook.exe -> cmd.exe
outlook.exe -> wscript.exe
outlook.exe -> regsvr32.exe
powerpnt.exe -> powershell.exe
powerpnt.exe -> cmd.exe
powerpnt.exe -> mshta.exe
onenote.exe -> powershell.exe
onenote.exe -> cmd.exe
onenote.exe -> wscript.exe
msaccess.exe -> powershell.exe
chrome.exe -> cmd.exe
chrome.exe -> powershell.exe
chrome.exe -> wscript.exe
firefox.exe -> cmd.exe
firefox.exe -> powershell.exe
msedge.exe -> cmd.exe
msedge.exe -> powershell.exe
iexplore.exe -> cmd.exe
iexplore.exe -> powershell.exe
iexplore.exe -> wscript.exe
mshta.exe -> powershell.exe
mshta.exe -> cmd.exe
mshta.exe -> wscript.exe
regsvr32.exe -> powershell.exe
regsvr32.exe -> cmd.exe
wscript.exe -> powershell.exe
wscript.exe -> cmd.exe
cscript.exe -> powershell.exe
cscript.exe -> cmd.exe
rundll32.exe -> powershell.exe
rundll32.exe -> cmd.exe
certutil.exe -> powershell.exe
msiexec.exe -> powershell.exe
msiexec.exe -> cmd.exe
installutil.exe -> powershell.exe
installutil.exe -> cmd.exe
pcalua.exe -> powershell.exe
pcalua.exe -> cmd.exe
xwizard.exe -> powershell.exe
xwizard.exe -> cmd.exe
services.exe -> powershell.exe
services.exe -> cmd.exe
services.exe -> wscript.exe
lsass.exe -> cmd.exe
lsass.exe -> powershell.exe
svchost.exe -> powershell.exe
svchost.exe -> cmd.exe
svchost.exe -> wscript.exe
taskhost.exe -> powershell.exe
taskhostw.exe -> powershell.exe
explorer.exe -> powershell.exe
explorer.exe -> regsvr32.exe
winlogon.exe -> cmd.exe
winlogon.exe -> powershell.exe
spoolsv.exe -> cmd.exe
spoolsv.exe -> powershell.exe
wmiprvse.exe -> powershell.exe
wmiprvse.exe -> cmd.exe
wmiprvse.exe -> wscript.exe
wmiprvse.exe -> mshta.exe
mmc.exe -> powershell.exe
mmc.exe -> cmd.exe
"""
