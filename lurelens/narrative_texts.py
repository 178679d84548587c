"""Sentences of the explanations, in English and Hindi. ``{by}`` names who recommends."""

FACETS = ["urgency", "fear", "authority_impersonation", "reward_bait", "financial_pressure"]

EN = {
    "intro": "This communication has been analyzed and classified as {category} (Risk Score: {score}/100).",
    "findings": "Analysis Findings:",
    "none": "• No active scam indicators or social engineering cues detected.",
    "urgency": "• It contains high-urgency language demanding immediate action to avoid consequences.",
    "fear": "• It attempts to induce fear, threatening legal action, police involvement, or account suspension.",
    "authority_impersonation": "• It impersonates an authority figure, government department, utility board, or bank support desk.",
    "reward_bait": "• It uses bait tactics, offering lottery winnings, gifts, rewards, or free cashbacks.",
    "financial_pressure": "• It references unpaid bills, pending charges, or fines to pressure you into paying.",
    "fake_kyc": "• The message intent is highly indicative of a Fake KYC verification scam designed to steal identity details.",
    "otp_theft": "• The message is structured to solicit an OTP (One-Time Password) or security PIN.",
    "upi_fraud": "• It requests or links to suspicious UPI payments or cash-request transfers.",
    "job_scams": "• It offers suspicious work-from-home or high-paying job opportunities with minimal requirements.",
    "delivery_scams": "• It mimics package tracking or delivery failure alerts to request payment or details.",
    "typosquatting": "• The link mimics the trusted brand '{brand}' but uses typosquatting (altered spelling) to deceive you.",
    "virustotal": "• The link was flagged as malicious or suspicious by multiple security engines on VirusTotal.",
    "recent_domain": "• The destination website domain is extremely new (registered less than 30 days ago).",
    "ssl_free": "• The website uses a free/anonymous SSL certificate, a setup frequently chosen for short-lived scam sites.",
    "ssl_invalid": "• The destination website has an invalid or expired SSL certificate, exposing you to connection tampering.",
    "sandbox_dom": "• Automated sandbox analysis detected input fields requesting passwords or payment details on the landing page.",
    "sandbox_timeout": "• The destination website failed to load or attempted to block automated inspection (hostile timeout penalty applied).",
    "Safe": "{by}Recommendation: The message appears safe, but always verify details before acting on unscheduled alerts.",
    "Suspicious": "{by}Recommendation: Exercise caution. Do not click links or share details. Verify the sender through official contact channels.",
    "High Risk": "{by}Recommendation: DO NOT click any links, do not share OTPs, and block the sender immediately. This is a confirmed threat.",
}

HI = {
    "intro": "इस संदेश का विश्लेषण किया गया है और इसे {category} (जोखिम स्कोर: {score}/100) के रूप में वर्गीकृत किया गया है।",
    "findings": "विश्लेषण के निष्कर्ष:",
    "none": "• कोई सक्रिय घोटाला संकेतक या सोशल इंजीनियरिंग संकेत नहीं मिले।",
    "urgency": "• इसमें परिणामों से बचने के लिए तत्काल कार्रवाई की मांग करने वाले शब्द शामिल हैं।",
    "fear": "• यह कानूनी कार्रवाई, पुलिस भागीदारी, या खाता निलंबन की धमकी देकर डर पैदा करने का प्रयास करता है।",
    "authority_impersonation": "• यह किसी सरकारी विभाग, बिजली विभाग, बैंक अधिकारी या सहायता कर्मचारी का रूप धारण करता है।",
    "reward_bait": "• यह लॉटरी, उपहार, कैशबैक, या पुरस्कार का लालच देने वाले हथकंडों का उपयोग करता है।",
    "financial_pressure": "• भुगतान के लिए दबाव बनाने के लिए यह बकाया बिलों या शुल्कों का संदर्भ देता है।",
    "fake_kyc": "• इसका इरादा नकली केवाईसी (KYC) सत्यापन घोटाला लगता है जो क्रेडेंशियल्स चुराने के लिए बनाया गया है।",
    "otp_theft": "• यह संदेश संभवतः ओटीपी (OTP) या सुरक्षा पिन चुराने के लिए बनाया गया है।",
    "upi_fraud": "• यह संदिग्ध यूपीआई (UPI) लेनदेन का अनुरोध या संचालन करता है।",
    "job_scams": "• यह संदिग्ध वर्क-फ्रॉम-होम या उच्च-कमाई वाले नकली नौकरी के अवसरों की पेशकश करता है।",
    "delivery_scams": "• यह व्यक्तिगत जानकारी प्राप्त करने के लिए कूरियर/पैकेज डिलीवरी समस्याओं की नकल करता है।",
    "typosquatting": "• यह लिंक एक विश्वसनीय ब्रांड '{brand}' की नकल करता है लेकिन आपको धोखा देने के लिए बदली हुई स्पेलिंग का उपयोग करता है।",
    "virustotal": "• यूआरएल को एंटीवायरस इंजन द्वारा दुर्भावनापूर्ण या संदिग्ध के रूप में चिह्नित किया गया था।",
    "recent_domain": "• यह लिंक एक बहुत ही हाल ही में पंजीकृत डोमेन (30 दिनों से कम समय पहले बनाया गया) की ओर इशारा करता है।",
    "ssl_free": "• वेबसाइट एक मुफ्त/अनाम एसएसएल प्रमाणपत्र का उपयोग करती है जो आमतौर पर अस्थायी धोखाधड़ी साइटों द्वारा उपयोग किया जाता है।",
    "ssl_invalid": "• वेबसाइट का एसएसएल सर्टिफिकेट अमान्य या समाप्त हो चुका है, जो आपके कनेक्शन को जोखिम में डालता है।",
    "sandbox_dom": "• सैंडबॉक्स स्कैन ने लैंडिंग पृष्ठ पर पासवर्ड या भुगतान इनपुट का पता लगाया है।",
    "sandbox_timeout": "• लैंडिंग पृष्ठ लोड होने में विफल रहा या स्वचालित निरीक्षण को अवरुद्ध करने का प्रयास किया (समय सीमा जुर्माना लागू)।",
    "Safe": "{by}सिफारिश: संदेश सुरक्षित प्रतीत होता है, लेकिन किसी भी संदिग्ध चेतावनी पर कार्रवाई करने से पहले हमेशा विवरणों को सत्यापित करें।",
    "Suspicious": "{by}सिफारिश: सावधानी बरतें। लिंक पर क्लिक न करें या विवरण साझा न करें। आधिकारिक चैनलों के माध्यम से प्रेषक की पहचान सत्यापित करें।",
    "High Risk": "{by}सिफारिश: किसी भी लिंक पर क्लिक न करें, ओटीपी (OTP) साझा न करें और प्रेषक को तुरंत ब्लॉक करें। यह एक पुष्टि खतरा है।",
}
